"""Sinks: deterministic caches, artifacts, ledgers and manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ledger import insert_new


def write_json_lines(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines in order, whole files in the order of their names: range-partitioned, so no task sorts all."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.text(path)


def artifact(record: Mapping, required: Sequence[str]) -> str:
    """A record as indented JSON with sorted keys; missing keys raise before anything is written."""
    if missing := [k for k in required if k not in record]:
        raise ValueError(f"artifact lacks {', '.join(missing)}")
    return json.dumps(dict(record), indent=2, sort_keys=True, default=str)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append ledger rows; a null endpoint or time stops the write."""
    checked = df.withColumn("endpoint", F.coalesce("endpoint", F.raise_error(F.lit("ledger row without endpoint"))))
    checked.write.mode("append").json(path)


def upsert_manifest(manifest: DataFrame, rows: DataFrame, key: str, path: str) -> None:
    """The manifest with new keys added, written to a new path: readers of the old one are not disturbed."""
    insert_new(manifest, rows, key).write.parquet(path)
