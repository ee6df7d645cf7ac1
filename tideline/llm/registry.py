"""The opN_ queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import jaccard_join, language_model, line_rules, mixing, neighbours, packing, registry_base, registry_text, repeats, secrets, toxicity, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op2_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.fit_and_score(language_model.held_out_rows(_table(spark, sf_dir, "documents")))


def op3_rake_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    p, out = mixing.names(docs), mixing.weighted(docs)
    added = ((v, "n_tokens" if k == "tokens" else k) for k, v in p.items())
    return out.select("doc_id", *[F.col(v).alias(k) for v, k in added])


def op4_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), of("novel").alias("n_novel"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(_table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("depleted")).alias("kept"), "words_removed")


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (
  SELECT d.rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols
  FROM d JOIN w USING (rid)),
raw_lines AS (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT rid, host, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                 trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS norm
          FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines GROUP BY rid),
hot AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS k FROM lines GROUP BY ALL)
  JOIN (SELECT host, count(DISTINCT t) AS h FROM lines GROUP BY host) USING (host)
  WHERE k > {line_rules.MAX_DOCS} AND k > {line_rules.MAX_SHARE} * h),
gone AS (SELECT rid, sum(n)::BIGINT AS words_removed FROM lines JOIN hot USING (host, norm) GROUP BY rid),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c >= 2),
cov AS (SELECT rid, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS n_repeat_words
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
a AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(words_removed, 0) AS words_removed
      FROM b LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND NOT (n_words > 0 AND n_words - words_removed < {line_rules.KEEP_SHARE} * n_words) AS kept,
       words_removed
FROM a
"""


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    train = labels.filter(toxicity.fold(3) != 1)
    model = toxicity.fit(docs, train)
    return toxicity.score(docs, model).select("doc_id", (toxicity.fold(3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op8_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"))


def op10_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_vp_tree, op2_gru_lm, op3_rake_mixture, op4_secret_novelty, op5_line_frequency, op6_toxicity_cnn, op7_wrapper_induction, op8_run_length_index, op9_best_fit, op10_jaccard_regions]
    import corpus_pipeline

    return {f.__name__: f for f in found} | registry_text.QUERIES | registry_base.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | registry_text.ORACLES | registry_base.ORACLES | {"op5_line_frequency": OP5_SQL}
