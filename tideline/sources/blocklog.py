"""A Spark data source over a paged block-log API, batch and streaming.

    spark.dataSource.register(BlockLogSource)
    spark.read.format("blocklog").options(fetcher="package.module:function", fromBlock=1, toBlock=10**6,
        chunkSize=10000, topics="0x..,0x..", address="0x..").load()

The fetcher is called as fetcher(address, first, last, topic) and returns at most pageSize log records of
the range, in order of block. A chunk of blocks and a topic are one partition, so a lost task fetches its
own range again and no other. Filters on `block` and `topic` choose the ranges that are fetched at all; Spark
hands them over where spark.sql.python.filterPushdown.enabled is set, and elsewhere takes no reader that wants them.
So load() gives the option pushFilters=false in a session without that setting: all ranges are read and Spark filters.

As a stream, offsets are blocks: a batch takes the blocks after the last one up to the head, less `confirmations`,
at most `blocksPerBatch` of them. The head comes from headFetcher (package.module:function, called with the
address), or is toBlock. A query resumes from its checkpoint.

With `path` instead of a fetcher, the logs are JSON lines in folders chunk=<first block>, as write_pages() leaves
them, on any file system that pyarrow knows.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

SCHEMA = "blockNumber string, blockHash string, transactionHash string, logIndex string, address string, topics array<string>, data string, timeStamp string"
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
#: What the source adds: the block as a number and the topic that was asked for, for filters.
ASKED = "block bigint, topic string"


class Range(InputPartition):
    def __init__(self, first: int, last: int, topic: str):
        self.first, self.last, self.topic = first, last, topic


def ranges(first: int, last: int, chunk: int, topics: list[str]) -> list[Range]:
    return [Range(a, min(a + chunk - 1, last), t) for a in range(first, last + 1, chunk) for t in topics]


def with_retry(f: Callable[[], list], tries: int = 6, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """f's result; failures are repeated with exponential waits up to `most` seconds."""
    for k in range(tries):
        try:
            return f()
        except OSError:
            if k == tries - 1:
                raise
            sleep(min(most, base * 2**k))
    return []


def pages(fetch: Callable[..., list[dict]], address: str, r: Range, page: int = 1000, tries: int = 6, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """All records of a range. The next page begins at the last block seen, which may go on, and repeats are dropped by transaction and index."""
    at, seen = r.first, set()
    while at <= r.last:
        got = with_retry(lambda at=at: fetch(address, at, r.last, r.topic), tries, sleep=sleep)
        fresh = [x for x in got if (x["transactionHash"], x["logIndex"]) not in seen]
        seen.update((x["transactionHash"], x["logIndex"]) for x in fresh)
        yield from fresh
        if len(got) < page:
            return
        last = int(got[-1]["blockNumber"], 16)
        if last == at and not fresh:
            raise ValueError(f"block {at} holds more than a page of {page} logs")
        seen = {k for k in seen if any(k == (x["transactionHash"], x["logIndex"]) and int(x["blockNumber"], 16) == last for x in got)}
        at = last


def _named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def write_pages(logs: DataFrame, path: str, chunk: int) -> None:
    """Log records (SCHEMA, and block as a number) as JSON lines in folders of `chunk` blocks, each in order of block and index."""
    first = (F.floor(F.col("block") / chunk) * chunk).cast("long")
    line = F.to_json(F.struct(*_FIELDS)).alias("value")
    d = logs.withColumn("chunk", first).repartitionByRange("chunk", "block").sortWithinPartitions("chunk", "block", "logIndex")
    d.select("chunk", line).write.mode("append").partitionBy("chunk").text(path)


def _chunks(path: str) -> dict[int, list[str]]:
    """The files of each chunk of a folder of pages."""
    from pyarrow import fs

    system, root = _system(path)
    out: dict[int, list[str]] = {}
    for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = f.path.split("/")
        if f.type == fs.FileType.File and len(parts) > 1 and parts[-2].startswith("chunk=") and not parts[-1].startswith(("_", ".")):
            out.setdefault(int(parts[-2].removeprefix("chunk=")), []).append(f.path)
    return {k: sorted(v) for k, v in sorted(out.items())}


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.removeprefix("file:"))


class _Source:
    """What the batch and the stream reader share: ranges of blocks and how one is read."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.topics = [t for t in self.options.get("topics", "").split(",") if t] or [""]

    def _int(self, name: str, default: int | None = None) -> int:
        return int(self.options[name] if default is None else self.options.get(name, default))

    def ranges(self, first: int, last: int) -> list[Range]:
        path, chunk = self.options.get("path"), self._int("chunksize", 10_000)
        if not path:
            return ranges(first, last, chunk, self.topics)
        kept = [k for k in _chunks(path) if k <= last and k + chunk > first]
        return [Range(max(k, first), min(k + chunk - 1, last), t) for k in kept for t in self.topics]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        """The rows of a range; where no range is left, Spark asks for none."""
        if partition is None:
            return
        for x in self._stored(partition) if self.options.get("path") else self._fetched(partition):
            block = x.get("blockNumber")
            yield (*(x.get(f) for f in _FIELDS), int(block, 16) if block else None, partition.topic or (x.get("topics") or [""])[0])

    def _fetched(self, r: Range) -> Iterator[dict]:
        yield from pages(_named(self.options["fetcher"]), self.options.get("address", ""), r, self._int("pagesize", 1000), self._int("tries", 6))

    def _stored(self, r: Range) -> Iterator[dict]:
        """The records of a range: only the folders of its own chunks are listed."""
        from pyarrow import fs

        chunk = self._int("chunksize", 10_000)
        system, root = _system(self.options["path"])
        for k in range(r.first // chunk * chunk, r.last + 1, chunk):
            found = system.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/chunk={k}", allow_not_found=True))
            for name in sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))):
                with system.open_input_stream(name) as raw:
                    for line in _lines(raw):
                        x = json.loads(line)
                        if r.first <= int(x["blockNumber"], 16) <= r.last and (not r.topic or r.topic in (x.get("topics") or [])[:1]):
                            yield x


def _lines(raw, size: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a stream, a buffer at a time."""
    rest = b""
    while part := raw.read(size):
        *whole, rest = (rest + part).split(b"\n")
        yield from (x for x in whole if x)
    if rest:
        yield rest


class BlockLogScan(_Source, DataSourceReader):
    """Reads every range that the options ask for."""

    def __init__(self, options: dict):
        super().__init__(options)
        if path := self.options.get("path"):
            known, chunk = _chunks(path), self._int("chunksize", 10_000)
            self.first, self.last = self._int("fromblock", min(known, default=0)), self._int("toblock", max(known, default=-chunk) + chunk - 1)
        else:
            self.first, self.last = self._int("fromblock"), self._int("toblock")

    def partitions(self) -> list[InputPartition]:
        return self.ranges(self.first, self.last)


class BlockLogReader(BlockLogScan):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on block bound the ranges and filters on topic choose among the topics that are asked for; others stay with Spark."""
        for f in filters:
            name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if name == ("block",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low = value + isinstance(f, GreaterThan) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) else self.first
                high = value - isinstance(f, LessThan) if isinstance(f, EqualTo | LessThan | LessThanOrEqual) else self.last
                self.first, self.last = max(self.first, low), min(self.last, high)
            elif name == ("topic",) and isinstance(f, EqualTo | In):
                asked = [t for t in ((value,) if isinstance(f, EqualTo) else value) if t]
                if self.topics != [""]:
                    self.topics = [t for t in self.topics if t in asked]
                elif asked:
                    self.topics = asked
                yield f  # an empty topic is a row's own, which Spark looks at again
            else:
                yield f


class BlockLogStream(_Source, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        self.sent = self._int("fromblock", 0) - 1
        return {"block": self.sent}

    def _head(self) -> int:
        o = self.options
        if o.get("headfetcher"):
            return int(_named(o["headfetcher"])(o.get("address", "")))
        if o.get("path"):
            return max(_chunks(o["path"]), default=-self._int("chunksize", 10_000)) + self._int("chunksize", 10_000) - 1
        return self._int("toblock")

    def latestOffset(self) -> dict:
        """The head less its confirmations, and what a batch may take; the first batch after a restart takes all up to the head."""
        sent = getattr(self, "sent", None)
        to = self._head() - self._int("confirmations", 0)
        if sent is not None:
            to = max(sent, min(to, sent + self._int("blocksperbatch", 1 << 40)))
        self.sent = to
        return {"block": to}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["block"] < start["block"]:
            raise ValueError(f"the head fell back to {end['block']}, blocks up to {start['block']} are taken")
        self.sent = max(getattr(self, "sent", end["block"]), end["block"])
        return self.ranges(start["block"] + 1, end["block"])

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class BlockLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocklog"

    def schema(self) -> str:
        return f"{SCHEMA}, {ASKED}"

    def reader(self, schema) -> DataSourceReader:
        o = {k.lower(): v for k, v in dict(self.options).items()}
        return (BlockLogScan if o.get("pushfilters", "true") == "false" else BlockLogReader)(o)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BlockLogStream(dict(self.options))


def load(spark: SparkSession, **options) -> DataFrame:
    """The source in a batch, whether or not the session hands filters over."""
    spark.dataSource.register(BlockLogSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("blocklog").options(pushFilters=pushed, **options).load()


def snapshot_blocks(blocks, fetch: Callable[[int], dict], schema: str):
    """Point-in-time reads, one a distinct block, in the tasks that hold the blocks; a failed read is a row of nulls.

    blocks has blockNumber; fetch gives the other columns of schema for a block.
    """
    import pandas as pd

    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for b in pdf["blockNumber"]:
                try:
                    rows.append({"blockNumber": b, **fetch(int(b))})
                except OSError:
                    rows.append({"blockNumber": b})
            yield pd.DataFrame(rows, columns=names)

    return blocks.select("blockNumber").distinct().mapInPandas(run, schema)
