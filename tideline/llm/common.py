"""What the operators of this subpackage share: tokens, shared storage, batching."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and words, as regular expressions for the JVM.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch while a step is written.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that setting is absent, a temporary folder is chosen and set in local mode, as in tests; on a
    cluster that would be a folder of one machine, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    # whole texts go to Python: small batches keep the workers small, whatever the session's setting
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(rows) if int(rows) > 0 else BATCH_ROWS, BATCH_ROWS)))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out.spilled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empty the folders of spilled tables that nothing will read again."""
    for t in tables:
        t.sparkSession.range(0).write.mode("overwrite").parquet(t.spilled_at)


def numbered(df: DataFrame, name: str, table: str = "rows") -> DataFrame:
    """df with a row id in the column `name`, as a written table.

    An id by place holds within one job only: how a scan is split follows the cores that are there when
    each job is planned, and a row's place after a shuffle follows the order of arrival. Written once, the
    ids are data: lost, late or new executors and other splits of later scans cannot move them.
    """
    return spill(df.withColumn(name, F.monotonically_increasing_id()), table)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, where the driver's JVM can be reached."""
    gc.collect()
    if (jvm := getattr(getattr(spark, "sparkContext", None), "_jvm", None)) is not None:
        jvm.System.gc()


def clean_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(name: str = "text") -> Column:
    """The number of words of a text, in the JVM."""
    return F.regexp_count(clean_text(name), F.lit(WORD)).cast("long")


def fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) for each row, the same in every run and under any partitioning."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double")) / F.lit(float(1 << 53))


def fresh(name: str, columns) -> str:
    """name, or with as many underscores before it as make it no column of the table."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
