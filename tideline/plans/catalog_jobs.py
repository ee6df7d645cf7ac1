"""Catalog: the jobs of the folder jobs, each run twice into one new folder, with SQL for what stands there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import leg_panel, text_manifest
from tideline.plans.registry import query
from tideline.session import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


@query(
    "job1_leg_panel",
    """
    WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events WHERE epoch_us(ts) <= (SELECT max(epoch_us(ts)) FROM events) - 120 * 1000000),
    f AS (SELECT * FROM e WHERE NOT (event_type = 'purchase' AND user_id IN (1, 2, 3, 5, 8))),
    l AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS leg, us, round(value * 100)::HUGEINT AS a FROM f WHERE event_type IN ('purchase', 'signup')),
    c AS (SELECT user_id, us AS rate_us, max(value) AS rate FROM f WHERE event_type = 'click' GROUP BY ALL),
    p AS (SELECT event_id, l.user_id, leg, us, a, CASE WHEN a > 0 THEN (a * 3000) // 997000 ELSE 0 END AS f, rate, rate_us,
            CASE WHEN rate_us IS NULL THEN 'unavailable' WHEN rate_us = us THEN 'exact' ELSE 'forward_fill' END AS method, make_timestamp(us)::DATE AS day
          FROM l ASOF LEFT JOIN c ON l.user_id = c.user_id AND l.us >= c.rate_us)
    SELECT event_id, user_id, leg::INTEGER AS leg, us, a::VARCHAR AS amount, f::VARCHAR AS fee, rate, rate_us, method, day,
      count(*) OVER d AS day_events, day_users, (sum(f) OVER d)::VARCHAR AS day_fees, count(*) FILTER (method = 'exact') OVER d AS day_exact, (sum((n > 1)::INTEGER) OVER d)::BIGINT AS day_ties
    FROM (SELECT *, count(*) OVER (PARTITION BY day, leg, us) AS n FROM p) JOIN (SELECT day, leg, count(DISTINCT user_id) AS day_users FROM p GROUP BY ALL) USING (day, leg)
    WINDOW d AS (PARTITION BY day, leg)
    """,
)
def job1_leg_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental leg panel after a run over everything and one that finds nothing new."""
    out = _folder(spark, "leg-panel")
    for _ in range(2):
        leg_panel.run(spark, sf_dir, out)
    return leg_panel.output(spark, out)


_LANES = [f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)" for k in range(text_manifest.LANES)]


@query(
    "job2_text_manifest",
    f"""
    WITH r AS (SELECT 'documents' AS kind, [doc_id] AS id, coalesce(source, '') AS source, text AS t FROM documents
      UNION ALL SELECT 'pages', [page_id], coalesce(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ''), html FROM pages
      UNION ALL SELECT 'conversations', [conv_id, turn], coalesce(role, ''), text FROM conversations),
    k AS (SELECT kind, id, source, sha256(t) AS key, octet_length(encode(t)) AS bytes FROM r),
    h AS (SELECT *, sha256(array_to_string(list_transform(id, lambda x: coalesce(x::VARCHAR, '-')), ':') || '|' || source || '|' || coalesce(key, '-')) AS h FROM k),
    s AS (SELECT kind, count(*) AS kind_rows, count(*) FILTER (key IS NULL) AS kind_null, coalesce(sum(bytes), 0)::VARCHAR AS kind_bytes, count(DISTINCT source) AS kind_sources, sha256(concat_ws(':', count(*), {', '.join(_LANES)})) AS kind_hash FROM h GROUP BY kind)
    SELECT kind, key, any_value(bytes)::BIGINT AS bytes, count(*)::BIGINT AS n_rows, array_to_string(min(id), ':') AS first_id, any_value(kind_rows)::BIGINT AS kind_rows, any_value(kind_null)::BIGINT AS kind_null,
      any_value(kind_bytes)::BIGINT AS kind_bytes, any_value(kind_sources)::BIGINT AS kind_sources, any_value(kind_hash) AS kind_hash
    FROM k JOIN s USING (kind) WHERE key IS NOT NULL GROUP BY kind, key
    """,
)
def job2_text_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming manifest of the text tables after a run over every file and one that finds none."""
    out = _folder(spark, "text-manifest")
    for _ in range(2):
        text_manifest.run(spark, sf_dir, out)
    return text_manifest.output(spark, out)
