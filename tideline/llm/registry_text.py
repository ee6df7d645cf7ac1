"""The queries op11 and op12, with the SQL of op12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import filter_audit, string_kernel


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = string_kernel.fit(docs.filter(string_kernel.fold(3) != 1))
    return string_kernel.predict(docs, model).select("doc_id", (string_kernel.fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_BIT = "(1 << (ascii(o[{i}]) - 65))"
_BEFORE = "CASE i " + " ".join(f"WHEN {i} THEN {' + '.join(['0', *(_BIT.format(i=j) for j in range(1, i))])}" for i in range(1, 6)) + " END"
AUDIT_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  m AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)::INT AS mask FROM d),
  l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS bad FROM labels GROUP BY doc_id),
  c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
  f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
  o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  s AS (SELECT o, i, {_BEFORE} AS before, 1 << (ascii(o[i]) - 65) AS bit FROM o, (SELECT unnest(range(1, 6)) AS i)),
  r AS (SELECT part, o, i, any_value(bit) AS bit, sum(n) FILTER (mask & before = 0 AND mask & bit = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
      sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
      sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(bad) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost FROM c, s GROUP BY part, o, i)
SELECT part, o AS filter_order, i::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""

QUERIES = {f.__name__: f for f in (op11_string_kernel, op12_filter_audit)}
ORACLES = {"op12_filter_audit": AUDIT_SQL}
