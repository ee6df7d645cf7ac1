"""String kernel and filter audit: against brute force, on messy rows, on held-out languages."""

import re
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_spark import BIG, CLASH, LONG, ROWS, TEXT
from tideline.llm import filter_audit, language_model, registry_base, registry_text, secrets, string_kernel

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def messy(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return base.withColumns({c: F.lit(f"own {c}") for c in [*CLASH, "_id", "_key", "part", "_t", "_len"]}).repartition(3)


# ---- op11


def test_grams_are_lower_case_letters_between_single_spaces():
    same = string_kernel.grams("Ab, c!")
    assert set(same) == set(string_kernel.grams("  aB 12\n C")) and set(same) != set(string_kernel.grams("abc"))
    assert string_kernel.grams(None) is None and string_kernel.grams(" 12 &\t") is None and string_kernel.grams("é") is not None
    # " ab c ": 4 single characters with the space, 5 pairs and 4 threes
    assert len(set(same)) == 4 + 5 + 4


def test_kernel_is_the_shared_share_of_grams():
    texts = [TEXT, TEXT.upper(), "the quick fox", LONG, "ü"]
    sets = [set(string_kernel.grams(t).tolist()) for t in texts]
    x = string_kernel.presence([string_kernel.grams(t) for t in texts])
    marks = x[[0, 3]]
    columns = np.flatnonzero(marks.any(axis=0))
    got = string_kernel.kernel(x, columns, marks[:, columns].T.astype(np.float32), np.sqrt(marks.sum(axis=1, dtype=np.int64)))
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in (sets[0], sets[3])] for a in sets]
    assert got == pytest.approx(np.array(want), abs=1e-12)


def test_solution_is_the_weighted_ridge_regression():
    rng = np.random.default_rng(3)
    table = (rng.random((40, 6)) < 0.5).astype(np.float32)
    roots = np.sqrt(table.sum(axis=0))
    k, lang = rng.normal(size=(90, 6)), np.arange(90) % 3
    m = string_kernel.solve(["a", "b", "c"], np.arange(40), table, roots, k, lang, ridge=0.1)
    gram = table.T.astype(float) @ table / np.outer(roots, roots)  # in the landmarks' span the penalty is beta' K beta
    x, y = np.column_stack([k, np.ones(90)]), np.where(np.arange(3) == lang[:, None], 1.0, -1.0)
    pen = np.zeros((7, 7))
    pen[:6, :6] = 0.1 * gram
    want = np.linalg.solve(x.T @ x / 90 + pen, x.T @ y / 90)
    assert np.vstack([m.weights, m.bias]) == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_messy_languages(spark, messy):
    model = string_kernel.fit(messy)
    assert model.languages == ["de", "en", "es"]  # the French text has no letter
    out = string_kernel.predict(messy, model)
    assert out.count() == len(ROWS) and set(messy.columns) - {"score"} < set(out.columns)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.filter("doc_id > 1").collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[BIG][0] in model.languages and 0 < got[8][1] <= 1
    assert out.filter(F.col("text") == TEXT).select("lang_pred", "score").distinct().count() == 1
    none = string_kernel.fit(messy.filter("false"))
    assert none.languages == [] and {r["lang_pred"] for r in string_kernel.predict(messy, none).collect()} == {"und"}
    assert string_kernel.predict(messy.filter("false"), model).count() == 0


def test_bounded_sample(spark):
    rows = [(i % 400, "the same words", "en") for i in range(4000)] + [(i, f"der die das {i}", "de") for i in range(30)] + [(None, "sans nom", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["_lang"]: r["n"] for r in string_kernel.sample(docs, per_language=50, most=80).groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    assert got == {"en": 40, "de": 30}


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = string_kernel.fit(docs.filter(string_kernel.fold(3) != 1))
    held = string_kernel.predict(docs, model).filter(string_kernel.fold(3) == 1).filter("lang IS NOT NULL")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 200
    one = held.limit(5).collect()
    alone = string_kernel.predict(spark.createDataFrame([(r["doc_id"], r["text"]) for r in one], "doc_id long, text string"), model, rows=1).collect()
    assert [(a["lang_pred"], a["score"]) for a in alone] == [(r["lang_pred"], r["score"]) for r in one]


# ---- op4


def test_names_leave_a_task_in_bounded_batches():
    texts = [None, "", "no such word"] + [f"token = val{i} " + " ".join(f"name_{i}_{k}" for k in range(15)) for i in range(6000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    out = list(secrets.names_near([batch]))
    assert len(out) > 3 and max(len(b) for b in out) < secrets.NAMES_AT_ONCE + 17
    found = pa.Table.from_batches(out)
    assert len(found) == 6000 * 17 and len(set(found.column("name").to_pylist())) == 6000 * 16 + 1 and len(set(found.column("h").to_pylist())) == 6000


# ---- op2


def test_equal_rows_teach_once_and_do_not_fill_the_sample(spark):
    rows = [(7, "the same words again", False)] * 3000 + [(1000 + i, f"some other words {i}", False) for i in range(200)] + [(None, "no id", False)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(6)
    model, _ = language_model.count(docs)
    encoded = language_model.encode(docs, model)
    sampled = language_model.first_rows(encoded, 3203, 300)
    assert sampled.count() == sampled.select("_h").distinct().count() <= 300
    d = encoded.select(F.lit(0).alias("g"), F.when(F.col("doc_id").isNull(), F.col("_rid")).otherwise(-1).alias("once"), "_h", "ids")
    left = d.mapInPandas(language_model.repeats_dropped, "g int, once long, _h long, ids binary")
    assert 204 <= left.count() <= 203 + 6 * 201 and left.select("once", "_h").distinct().count() == 204
    language_model.learn(model, encoded, 300, 1)
    out = language_model.score_encoded(encoded, model, language_model.count(docs)[1])
    same = out.filter("doc_id = 7").agg(F.count("*"), F.max("score") - F.min("score")).first()
    assert out.count() == 3203 and same[0] == 3000 and same[1] < 1e-3


def test_words_in_batches_are_the_words_of_each_text():
    odd = ["".join(f"a{chr(i)}" for i in range(256)), None, "", " \t\x0b ", "ÀÉ Zz\u2003z\u0085z", "\x1cX\x1f Y", " lead and trail\r\n", "I\u0130\u212a", "x"]
    for texts in (odd, odd[1:4], []):
        words, sizes = language_model.split_words(pa.array(texts, pa.string()))
        want = [language_model.words_of(t) for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and [w.encode() for w in words.to_pylist()] == sum(want, [])
    batch = pa.RecordBatch.from_pydict({"text": pa.array(odd, pa.string())})
    cut = list(language_model.pieces(batch, 5))
    assert len(cut) > 3 and pa.Table.from_batches(cut).column("text").to_pylist() == odd


def test_rare_words_meet_their_counts_without_a_sort(spark):
    docs = spark.createDataFrame([(i, f"some words and rare{i % 5} ones", i % 3 == 0) for i in range(20)], "doc_id long, text string, held_out boolean")
    model, counts = language_model.count(docs, head=4)
    out = language_model.based(language_model.encode(docs, model), model, counts)
    rows = out.collect()
    assert len(model.head) == 4 and len(rows) == 20 and {r["n_known"] for r in rows} == {6}
    assert "ShuffledHashJoin [tail" in out._jdf.queryExecution().toString()


def test_base_scores_are_those_of_op2_and_train_no_net(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    whole = language_model.fit_and_score(language_model.held_out_rows(spark.read.parquet(f"{sf}/documents.parquet")))
    want = sorted(tuple(r) for r in whole.select(*columns[:-1], F.round("base_score", 4)).collect())
    monkeypatch.setattr(language_model, "train", lambda *a, **k: pytest.fail("a net was trained on the driver"))
    monkeypatch.setattr(language_model, "learn", lambda *a, **k: pytest.fail("a net was trained"))
    got = registry_base.lm_base_scores(spark, sf)
    assert got.columns == columns and sorted(tuple(r) for r in got.collect()) == want


# ---- op12


def brute_audit(docs, labels):
    """Every count from its definition, over rows (doc_id, source, text)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, source, text in docs:
        t = text or ""
        ws = WORD.findall(t)
        copies = [j for j, _, u in docs if (u or "") == t and j is not None]
        fails = {f for f, x in zip("ABCDE", (len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and any(j < i for j in copies)), strict=True) if x}
        rows.append((source or "", fails, i in good, i in bad))
    out = []
    for part in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == part]
        value = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                value[f] += len(gone)
                mine.append((part, "".join(order), step, len(left) - len(gone), len(gone), sum(f in r[1] for r in own) - sum(f in r[1] for r in left), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
                left = [r for r in left if f not in r[1]]
        out += [(*m, value[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


FIFTY = " ".join(f"w{i}" for i in range(50))
DOCS = [
    (1, "a", FIFTY), (1, "a", FIFTY), (2, "b", FIFTY), (None, "b", FIFTY), (3, None, None), (4, None, ""), (5, "a", FIFTY + " #"), (6, "a", FIFTY.upper()), (7, "a", "x " * 60),
    (8, "b", "é" * 70 + FIFTY), (9, "b", "é" * 70 + FIFTY + "!"), (10, "b", LONG), (11, "c", LONG), (12, "c", LONG[:-1] + "!"), (13, "c", "A$ " * 40), (14, "c", "A$ " * 40), (-3, "c", "A$ " * 40),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 1, 1), (6, None, 1), (14, 1, 1), (None, 1, 1), (77, 1, 1)]


@pytest.mark.parametrize("bits", [64, 1])
def test_audit_equals_brute_force_also_where_hashes_collide(spark, bits):
    docs = spark.createDataFrame(DOCS, "doc_id long, source string, text string").repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(docs, labels, bits)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == brute_audit(DOCS, LABELS)


def test_refinement_keeps_what_agrees_in_every_block(spark):
    long = "x" * 20_000
    texts = ["a", "b", "a", long, long, long[:-1] + "y", "y" + long[1:], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_t"))
    rows = docs.select("_id", F.length("_t").alias("_len"), F.array(*filter_audit.block_hashes(F.col("_t"))).alias("_hashes"))
    assert sorted(r["_id"] for r in filter_audit.refine(rows).collect()) == [0, 2, 3, 4, 7, 8]


def test_the_map_lets_members_through_and_few_others(spark):
    keys = spark.range(5000).select((F.xxhash64("id")).alias("_key"), "id")
    got = {r["id"] for r in filter_audit.may_hold(keys, keys.filter("id % 50 = 0").select("_key")).collect()}
    assert {i for i in range(0, 5000, 50)} <= got and len(got) < 110
    assert filter_audit.may_hold(keys, keys.filter("false").select("_key")).count() == 0


def test_messy_audit(spark, messy):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("_id", F.lit("own"))
    out = filter_audit.audit(messy, labels)
    assert sorted(map(tuple, out.collect())) == brute_audit([(i, s, t) for i, t, _, s in ROWS], LABELS)
    assert filter_audit.audit(messy.filter("false"), labels).count() == 0
    assert filter_audit.audit(messy, labels.filter("false")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_audit_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = registry_text.op12_filter_audit(spark, SF)
    cur = con.execute(registry_text.AUDIT_SQL)
    assert [d[0] for d in cur.description] == out.columns and sorted(cur.fetchall()) == sorted(map(tuple, out.collect()))
