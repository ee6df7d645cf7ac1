"""Queries over the operators' results that SQL can express in full, with their oracles.

Each runs its operator by its method and keeps the columns, or the sums, that SQL can state; op8 and op10
are stated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import language_model, mixing, neighbours, packing, repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lower case for A-Z alone, and words.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: crc32 of a string of ASCII, byte by byte over the table of its polynomial.
_CRC = """steps AS (SELECT i, i::BIGINT AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i)
    UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
  crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8)"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"


LM_SQL = f"""WITH RECURSIVE {_CRC},
  d AS (SELECT row_number() OVER () AS rid, doc_id, {_crc("doc_id::VARCHAR")} % 7 = 2 AS held_out, {_WORDS} AS ws FROM documents, crc),
  w AS (SELECT rid, held_out, unnest(ws) AS w FROM d), c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w),
  e AS (SELECT count(*) FILTER (NOT held_out) AS ends FROM d), s AS (SELECT (SELECT coalesce(sum(c), 0) FROM c) + ends AS n, (SELECT count(*) FROM c) + (ends > 0)::INT AS v, ends FROM e),
  x AS (SELECT rid, sum(log10(coalesce(c, 0) + 1)) AS l, count(c) AS k FROM w LEFT JOIN c USING (w) GROUP BY rid)
SELECT doc_id, held_out, (len(ws) + 1)::BIGINT AS n_tokens, (coalesce(k, 0) + (ends > 0)::INT)::BIGINT AS n_known, n::BIGINT AS train_tokens,
  round(coalesce(l, 0) + log10(ends + 1) - (len(ws) + 1) * log10(n + v + 1), 4) AS base_score FROM d LEFT JOIN x USING (rid), s"""


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op2, which do not depend on its net: none is trained."""
    got = language_model.base_scores(language_model.held_out_rows(_table(spark, sf_dir, "documents")))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


NEIGHBOURS_SQL = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  p AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, b.rid AS found, list_distance(a.e, b.e) AS score FROM u a JOIN u b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score, vec_id, found) AS rank FROM p) WHERE rank <= 10"""


def neighbours_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 with factor one, which is exact."""
    got = neighbours.nearest(_table(spark, sf_dir, "embeddings"), every=100, k=10, factor=1.0)
    return got.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


_SET = f"""d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
  s AS (SELECT DISTINCT rid, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
  n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid)"""

JACCARD_SQL = f"""WITH RECURSIVE {_SET},
  b AS (SELECT x.rid AS p, y.rid AS q, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.rid < y.rid GROUP BY ALL),
  l AS (SELECT p, q FROM b JOIN n x ON x.rid = p JOIN n y ON y.rid = q WHERE 100 * k >= 75 * (x.n + y.n - k)),
  links AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
  r AS (SELECT rid AS p, rid AS q FROM d UNION SELECT r.p, links.q FROM r JOIN links ON links.p = r.q)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (rid)
  JOIN (SELECT r.p AS rid, min(doc_id) AS c FROM r JOIN d ON d.rid = r.q GROUP BY r.p) USING (rid)"""

REPEATS_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
  g AS (SELECT rid, i, md5(array_slice(b, i, i + {repeats.LENGTH - 1})) AS h FROM (SELECT rid, b, unnest(range(1, octet_length(b) - {repeats.LENGTH - 2})) AS i FROM d WHERE octet_length(b) >= {repeats.LENGTH})),
  m AS (SELECT rid, i, coalesce(i > max(i) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {repeats.LENGTH}, TRUE) AS fresh
        FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
  s AS (SELECT rid, min(i) AS a, max(i) + {repeats.LENGTH} AS z FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS k FROM m) GROUP BY rid, k),
  cut AS (SELECT rid, z AS a, coalesce(lead(a) OVER (PARTITION BY rid ORDER BY a), NULL) AS z FROM (SELECT rid, a, z FROM s UNION ALL SELECT rid, 0, 1 FROM d)),
  kept AS (SELECT rid, string_agg(hex(array_slice(b, cut.a, coalesce(cut.z, octet_length(b) + 1) - 1)), '' ORDER BY cut.a) AS x FROM cut JOIN d USING (rid) WHERE cut.a < coalesce(cut.z, octet_length(b) + 1) GROUP BY rid),
  t AS (SELECT rid, sum(z - a)::BIGINT AS n, count(*) AS k FROM s GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (rid) LEFT JOIN kept USING (rid)"""

_CASE = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN = rf"""(?:{_CASE("password")}|{_CASE("passwd")}|{_CASE("secret")}|{_CASE("token")}|{_CASE("api")}_?{_CASE("key")})["'']?\x20*[:=]\x20*["'']?"""


def _spans(kind: str, order: int, head: str, body: str, least: int) -> str:
    """Spans of a pattern: each match after the shortest text before it, so that lengths add up to places."""
    found = lambda k: f"regexp_extract_all(t, '(?s)(.*?)({head})({body})', {k})"
    return f"""SELECT rid, '{kind}' AS kind, {order} AS o, sum(length(p) + length(h) + length(x)) OVER (PARTITION BY rid ORDER BY j) - length(x) - length(h) AS a, length(h) + length(x) AS n, length(x) >= {least} AS fine
      FROM (SELECT rid, unnest({found(1)}) AS p, unnest({found(2)}) AS h, unnest({found(3)}) AS x, generate_subscripts({found(1)}, 1) AS j FROM d)"""


SECRETS_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
  s AS ({_spans("assign", 0, _ASSIGN, "[A-Za-z0-9+/_.=-]+", 6)} UNION ALL {_spans("access", 1, "AKIA", "[A-Z0-9]+", 16)} UNION ALL {_spans("hex", 2, "", "[0-9a-f]+", 24)}),
  f AS (SELECT rid, count(*) FILTER (kind = 'assign') AS x, count(*) FILTER (kind = 'access') AS y, count(*) FILTER (kind = 'hex') AS z, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS line FROM s WHERE fine GROUP BY rid)
SELECT doc_id, coalesce(x, 0)::BIGINT AS n_assign, coalesce(y, 0)::BIGINT AS n_access, coalesce(z, 0)::BIGINT AS n_hex, sha256(coalesce(line, '')) AS base_sha256 FROM d LEFT JOIN f USING (rid)"""


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op4."""
    from tideline.llm import registry

    return registry.op4_secret_novelty(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


_SHARES = lambda m: f"SELECT '{m}' AS margin, coalesce({m}, '(null)') AS category, pow(sum(n), {mixing.POWER}) AS w FROM d WHERE n > 0 GROUP BY ALL"
MIXTURE_SQL = rf"""WITH d AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents), t AS ({_SHARES("source")} UNION ALL {_SHARES("lang")})
SELECT margin, category, round(w / sum(w) OVER (PARTITION BY margin), 6) AS share FROM t"""


def mixture_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that op3's weights give each source and language: their targets."""
    docs = _table(spark, sf_dir, "documents")
    p, out = mixing.names(docs), mixing.weighted(docs)
    mass = out.filter(F.col(p["tokens"]) > 0).withColumn("_m", F.col(p["tokens"]) * F.col(p["weight"]))
    each = mass.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(p[m]).alias("category")) for m in ("source", "lang")])).alias("x"), "_m")
    sums = each.groupBy("x").agg(F.sum("_m").alias("m"))
    total = sums.groupBy(F.col("x.margin").alias("margin")).agg(F.sum("m").alias("all"))
    return sums.select("x.*", "m").join(total, "margin").select("margin", "category", F.round(F.col("m") / F.col("all"), 6).alias("share"))


PACKING_SQL = rf"""SELECT doc_id, len(ws)::BIGINT AS n_tokens, greatest(1, ceil(len(ws) / {packing.CAPACITIES[-1]}.0))::BIGINT AS pieces, TRUE AS fits
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 keeps of each document, and whether all of its pieces lie in bins of the least size for their contents."""
    out = packing.best_fit(_table(spark, sf_dir, "documents"))
    least = F.lit(packing.CAPACITIES[-1])
    bins = out.filter("bin_id IS NOT NULL").groupBy("bin_id").agg(F.sum("n_tokens").alias("used"), F.count_distinct("bin_offset").alias("places"), F.count("*").alias("all"), F.min("capacity").alias("low"), F.max("capacity").alias("high"))
    for c in reversed(packing.CAPACITIES[:-1]):
        least = F.when(F.col("used") <= c, c).otherwise(least)
    good = bins.select("bin_id", ((F.col("low") == F.col("high")) & (F.col("low") == least) & (F.col("used") <= F.col("low")) & (F.col("places") == F.col("all"))).alias("good"))
    met = out.join(good, "bin_id", "left")
    return met.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("pieces"), F.bool_and(F.coalesce("good", F.col("n_tokens") == 0)).alias("fits"))


QUERIES = {f.__name__: f for f in (lm_base_scores, neighbours_exact, secret_base_spans, mixture_margins, packing_totals)}
ORACLES = {
    "lm_base_scores": LM_SQL, "neighbours_exact": NEIGHBOURS_SQL, "secret_base_spans": SECRETS_SQL, "mixture_margins": MIXTURE_SQL, "packing_totals": PACKING_SQL,
    "op8_run_length_index": REPEATS_SQL, "op10_jaccard_regions": JACCARD_SQL,
}
