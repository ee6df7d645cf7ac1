"""The jobs over growing input: what is new is taken, what was taken stays, and a broken run leaves no trace."""

import logging
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import leg_panel, text_manifest
from tests.conftest import SF

ROOT = str(Path(__file__).parents[1])


def rows(df):
    return sorted(map(repr, df.collect()))


# ---- job 1


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("own_column", F.lit("x"))


def grown(events, spark, path, until):
    """The events up to a share of the stretch of time, written as a table at path."""
    lo, hi = (x.timestamp() for x in events.agg(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).first())
    events.filter(F.unix_timestamp(F.col("ts").cast("timestamp")) <= lo + until * (hi - lo)).write.mode("overwrite").parquet(f"{path}/events.parquet")


def test_leg_panel_grows_to_what_one_run_makes(spark, events, tmp_path):
    whole = f"{tmp_path}/whole"
    grown(events, spark, f"{tmp_path}/all", 1)
    first = leg_panel.run(spark, f"{tmp_path}/all", whole)
    assert first["since"] is None and first["wrote"] > 0
    out, seen = f"{tmp_path}/out", []
    for share in (0.3, 0.31, 0.7, 1):
        grown(events, spark, f"{tmp_path}/some", share)
        seen.append(leg_panel.run(spark, f"{tmp_path}/some", out))
    assert [s["upto"] for s in seen[:-1]] == [s["since"] for s in seen[1:]] and sum(s["wrote"] for s in seen) == first["wrote"]
    assert sum(s["read"] for s in seen) == first["read"] and seen[-1]["upto"] == first["upto"]
    assert rows(leg_panel.output(spark, out)) == rows(leg_panel.output(spark, whole))
    before = rows(leg_panel.stored(spark, f"{out}/mark", leg_panel.MARK))
    assert leg_panel.run(spark, f"{tmp_path}/some", out)["wrote"] == 0
    assert rows(leg_panel.stored(spark, f"{out}/mark", leg_panel.MARK)) == before


def test_leg_panel_after_a_run_that_died_before_its_mark(spark, events, tmp_path, monkeypatch):
    out, tables = f"{tmp_path}/out", f"{tmp_path}/tables"
    grown(events, spark, tables, 0.4)
    leg_panel.run(spark, tables, out)
    grown(events, spark, tables, 0.6)
    with monkeypatch.context() as m:
        m.setattr(leg_panel, "summed", lambda df: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            leg_panel.run(spark, tables, out)
    grown(events, spark, tables, 1)
    leg_panel.run(spark, tables, out)
    leg_panel.run(spark, tables, f"{tmp_path}/whole")
    assert rows(leg_panel.output(spark, out)) == rows(leg_panel.output(spark, f"{tmp_path}/whole"))


def test_leg_panel_of_odd_rows(spark, tmp_path):
    at = "2024-01-01 00:00:0"
    data = [(1, 7, "click", 2.0, at + "0"), (2, 7, "purchase", 1.5, at + "0"), (3, 7, "purchase", None, at + "1"), (4, None, "signup", 3.0, at + "1"), (4, None, "purchase", 3.0, at + "1"), (5, 1, "purchase", 9.0, at + "1"), (5, 9, "signup", 1.0, at + "2"), (5, 9, "signup", 1.0, at + "2"), (6, 7, None, 1.0, at + "2"), (7, 7, "purchase", 1.0, None), (8, 7, "view", 0.0, "2024-01-02 00:00:00")]
    spark.createDataFrame(data, "event_id long, user_id long, event_type string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/t/events.parquet")
    leg_panel.run(spark, f"{tmp_path}/t", f"{tmp_path}/o")
    got = sorted((r["event_id"], r["leg"], r["amount"], r["fee"], r["rate"], r["method"], r["day_events"], r["day_ties"]) for r in leg_panel.output(spark, f"{tmp_path}/o").collect())
    assert [g[:3] + g[4:] for g in got] == [
        (2, 0, "150", 2.0, "exact", 2, 0), (3, 0, None, 2.0, "forward_fill", 2, 0), (4, 1, "300", None, "unavailable", 3, 2),
        (5, 1, "100", None, "unavailable", 3, 2), (5, 1, "100", None, "unavailable", 3, 2),
    ]
    empty = spark.read.parquet(f"{tmp_path}/t/events.parquet").filter("false")
    empty.write.parquet(f"{tmp_path}/e/events.parquet")
    assert leg_panel.run(spark, f"{tmp_path}/e", f"{tmp_path}/none")["wrote"] == 0 and leg_panel.output(spark, f"{tmp_path}/none").count() == 0


# ---- job 2


CONFIG = {"files_per_batch": 1, "tables": [{"name": "documents", "id": ["doc_id"], "text": "text", "source": "source"}]}


def add(spark, path, data):
    spark.createDataFrame(data, "doc_id long, text string, source string, batch long, key string").coalesce(1).write.mode("append").parquet(f"{path}/documents.parquet")


FIRST = [(1, "a", "s", 0, "own"), (2, "a", None, 0, None), (3, None, "s", 0, None), (4, "", "s", 0, None)]
MORE = [(0, "a", "s", 0, None), (5, "é" * 3, "t", 0, None), (5, "é" * 3, "t", 0, None), (None, "b", None, 0, None)]


def test_manifest_grows_to_what_one_run_makes(spark, tmp_path):
    tables, out = f"{tmp_path}/t", f"{tmp_path}/o"
    add(spark, tables, FIRST)
    assert text_manifest.run(spark, tables, out, CONFIG) == {"documents": 1}
    held = rows(spark.read.parquet(f"{out}/manifest"))
    add(spark, tables, MORE)
    assert text_manifest.run(spark, tables, out, CONFIG) == {"documents": 1}
    assert text_manifest.run(spark, tables, out, CONFIG) == {"documents": 0}
    assert set(held) <= set(rows(spark.read.parquet(f"{out}/manifest"))) and len(held) == 2
    got = {r["first_id"]: (r["n_rows"], r["bytes"], r["kind_rows"], r["kind_null"], r["kind_sources"]) for r in text_manifest.output(spark, out).collect()}
    assert got == {"0": (3, 1, 8, 1, 3), "4": (1, 0, 8, 1, 3), "5": (2, 6, 8, 1, 3), "": (1, 1, 8, 1, 3)}
    text_manifest.run(spark, tables, f"{tmp_path}/whole", CONFIG | {"files_per_batch": 10})
    assert rows(text_manifest.output(spark, out)) == rows(text_manifest.output(spark, f"{tmp_path}/whole"))


def test_a_batch_taken_again_leaves_one_copy(spark, tmp_path, monkeypatch):
    tables, out = f"{tmp_path}/t", f"{tmp_path}/o"
    add(spark, tables, FIRST)
    add(spark, tables, MORE)
    real, calls = text_manifest.put, []

    def dies(df, path):
        calls.append(path)
        if len(calls) == 6:  # the second batch's manifest, after its ledger and copies
            raise RuntimeError("lost")
        real(df, path)

    with monkeypatch.context() as m:
        m.setattr(text_manifest, "put", dies)
        with pytest.raises(Exception, match="lost"):
            text_manifest.run(spark, tables, out, CONFIG)
    text_manifest.run(spark, tables, out, CONFIG)
    text_manifest.run(spark, tables, f"{tmp_path}/whole", CONFIG | {"files_per_batch": 10})
    assert rows(text_manifest.output(spark, out)) == rows(text_manifest.output(spark, f"{tmp_path}/whole"))
    assert spark.read.parquet(f"{out}/ledger").agg(F.sum("n_rows")).first()[0] == 8


def test_jobs_leave_settings_alone_and_say_what_they_did(spark, tmp_path, caplog):
    before = {k: v for k, v in spark.conf.getAll.items()}
    add(spark, f"{tmp_path}/t", FIRST)
    with caplog.at_level(logging.INFO):
        text_manifest.run(spark, f"{tmp_path}/t", f"{tmp_path}/o", CONFIG)
    assert "read 4 rows, wrote 2 new texts" in caplog.text
    assert {k: v for k, v in spark.conf.getAll.items()} == before


@pytest.mark.parametrize("job", ["leg_panel", "text_manifest"])
def test_command_line(tmp_path, job):
    out = f"{tmp_path}/out"
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--tables", SF, "--out", out], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and any(Path(out).iterdir())
