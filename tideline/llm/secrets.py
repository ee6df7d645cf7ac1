"""Secret scans: fixed patterns, and what a primed zstandard coder finds novel.

A candidate is a long unbroken string soon after a sensitive word, or a line that carries on a reported
one, as in a wrapped key. Its novelty is the number of
bytes by which the compressed size of its surroundings grows when it is added, with a coder primed
by the corpus's own identifiers: names that occur elsewhere cost little, random strings nearly
their entropy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that make what follows them sensitive.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "private", "credential", "bearer", "authorization", "access_key", "accesskey", "client_id", "signature")
_NEAR = re.compile("(?ai)" + "|".join(map(re.escape, SENSITIVE)))
_STEMS = tuple(dict.fromkeys(s.encode() for s in SENSITIVE if not any(o != s and o in s for o in SENSITIVE)))
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,39}")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PIECE = 8  # characters from which a name or a part of a string can be random without a digit
_IS_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
REACH = 64  # characters from a sensitive word to a candidate's start
AROUND = 256  # characters of surroundings on each side
RATIO = 0.55  # marginal bytes a character from which a candidate is novel
PLAIN_RATIO = 0.8  # the same for one without a digit, as long words of prose cost more than names
WRAPPED = 40  # characters from which a reported string can be a line of a longer secret
#: The rest of a line after a string, the break, written or escaped, and a next line that is one string.
_NEXT = re.compile(r"""["'\\,;+\ \t]*(?:\r?\n|\\n)[\ \t>#*"'|]*([A-Za-z0-9+/_=.~-]{4,})(?=["'\\,;+\ \t]*(?:\r?\n|\\n|$))""")
DICTIONARY_NAMES = 4096
#: Names, and texts, that a task holds at once beside its batch.
NAMES_AT_ONCE, TEXTS_AT_ONCE = 20_000, 500


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = []
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_IS_HEX):
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def sensitive(text: str) -> bool:
    low = text.encode("utf-8", "surrogatepass").lower()
    return any(s in low for s in _STEMS)


def outside(start: int, end: int, cuts: list[tuple[int, int]], first: int = 0) -> Iterator[tuple[int, int]]:
    """The parts of [start, end) that no cut covers; cuts are sorted and those before `first` end before start."""
    i = first
    while i < len(cuts) and cuts[i][0] < end:
        if start < cuts[i][0]:
            yield start, cuts[i][0]
        start, i = max(start, cuts[i][1]), i + 1
    if start < end:
        yield start, end


def candidates(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Long unbroken strings, whole, that start soon after a sensitive word, less the spans in taken.

    What a span leaves of a string is of interest if it has a digit or is long.
    """
    runs = [m.span() for m in _CANDIDATE.finditer(text)]
    cuts = sorted((s, e) for s, e, _ in taken)
    at = cut = done = 0
    for m in _NEAR.finditer(text):
        while at < len(runs) and runs[at][1] <= m.end():
            at += 1
        for i in range(at, len(runs)):
            start, end = max(runs[i][0], m.end()), runs[i][1]
            if start > m.end() + REACH:
                break
            if start < done or end - start < 16:
                continue
            done = end
            while cut < len(cuts) and cuts[cut][1] <= start:
                cut += 1
            for s, e in outside(start, end, cuts, cut):
                if e - s >= _PIECE or any(c.isdigit() for c in text[s:e]):
                    yield s, e


def following(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The lines that carry on a wrapped secret: each one string, as long as the one before; a shorter one ends it.

    The first may be longer than what was found, which can begin in the middle of its line.
    """
    width = None
    while end - start >= WRAPPED and (m := _NEXT.match(text, end)):
        start, end = m.span(1)
        if width is not None and end - start > width:
            return
        yield start, end
        if width is not None and end - start < width:
            return
        width = end - start


def coder(dictionary: bytes):
    import zstandard

    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def novelty(compressor, text: str, start: int, end: int) -> float:
    """Marginal compressed bytes a byte of text[start:end] after its surroundings."""
    around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode("utf-8", "surrogatepass")
    it = text[start:end].encode()
    return (len(compressor.compress(around + it)) - len(compressor.compress(around))) / max(1, len(it))


def is_novel(compressor, text: str, start: int, end: int, ratio: float) -> bool:
    """Whether a candidate costs enough; one without a digit must cost PLAIN_RATIO of what others must."""
    plain = not any(c.isdigit() for c in text[start:end])
    return novelty(compressor, text, start, end) >= (ratio * PLAIN_RATIO / RATIO if plain else ratio)


def all_spans(text: str | None, compressor, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """Base and novel spans by start, then kind as in KINDS.

    Candidates are strings soon after a sensitive word, and then, line by line, what carries on a reported
    string of WRAPPED characters or more, however far that leads.
    """
    if not text:
        return []
    found = base_spans(text)
    if sensitive(text):
        base = sorted((s, e) for s, e, _ in found)
        new = {(s, e) for s, e in candidates(text, found) if is_novel(compressor, text, s, e, ratio)}
        seen: set[tuple[int, int]] = set()
        for s, e in sorted([*base, *new]):
            for line in following(text, s, e):
                if line in seen:
                    break
                seen.add(line)
                parts = [p for p in outside(*line, base) if p not in new]
                fine = [p for p in parts if novelty(compressor, text, *p) >= ratio]
                if parts and not fine:
                    break
                new.update(fine)
        reached = 0
        for s, e in sorted(new, key=lambda x: (x[0], -x[1])):
            if e > reached:  # else it lies within another, as a line that was also reached from its middle on
                found.append((s, e, "novel"))
                reached = e
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def identifiers(names: list[str]) -> list[str]:
    """The names that do not look random, in their order.

    Plain names are made of parts of three letters on average, without digits; short ones may have digits.
    Others stay if they cost little to a coder primed with the plain ones alone, as made of the same words.
    """

    def plain(name: str) -> bool:
        parts = _PART.findall(name)
        return bool(parts) and sum(map(len, parts)) >= 3 * len(parts) and (len(name) < _PIECE or not any(c.isdigit() for c in name))

    known = {name for name in names if plain(name)}
    compressor = coder("\n".join(name for name in names if name in known).encode())
    return [name for name in names if name in known or novelty(compressor, name, 0, len(name)) < RATIO]


def names_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name and the hash of its text of every name around a sensitive word, at most NAMES_AT_ONCE and one text's names at once."""
    out = lambda: pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(hashes, pa.int64())], names=["name", "h"])
    found: list[str] = []
    hashes: list[int] = []
    for batch in batches:
        for each in batch.column("text"):
            text = each.as_py()
            if text and sensitive(text):
                seen = set()
                for m in _NEAR.finditer(text):
                    seen.update(_NAME.findall(text, max(0, m.start() - AROUND), m.end() + AROUND))
                h = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                found += seen
                hashes += [h] * len(seen)
            if len(found) >= NAMES_AT_ONCE:
                yield out()
                found, hashes = [], []
    if found:
        yield out()


def identifier_dictionary(docs: DataFrame, names: int = DICTIONARY_NAMES) -> bytes:
    """The most frequent names around sensitive words of all documents, the most frequent last.

    A name counts once a distinct text, and only if two or more have it, so copies do not count. Names
    that look random (see identifiers) are left out. At most `names` of at most 40 bytes come to the driver.
    """

    counted = docs.select("text").mapInArrow(names_near, "name string, h long").distinct().groupBy("name").agg(F.count("*").alias("n")).filter("n >= 2")
    top = counted.orderBy(F.desc("n"), "name").limit(names).collect()
    return "\n".join(identifiers([r["name"] for r in reversed(top)])).encode()


def scan(docs: DataFrame, ratio: float = RATIO, names: int = DICTIONARY_NAMES) -> DataFrame:
    """doc_id and an array of spans (start, end, kind), in code points, end exclusive.

    Null and empty texts have no spans. Every row gives one row, repeated rows and null ids too; other
    columns are ignored. Overlapping spans of different kinds all stay.
    """
    words = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs, names))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = coder(words.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in (b.slice(a, TEXTS_AT_ONCE) for b in batches for a in range(0, len(b), TEXTS_AT_ONCE)):
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in all_spans(t.as_py(), compressor, ratio)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redact(docs: DataFrame, mask: str = "[SECRET]", ratio: float = RATIO, names: int = DICTIONARY_NAMES) -> DataFrame:
    """docs with every span of scan() in text replaced by mask; overlapping spans become one mask.

    The columns stay as they are; n_chars, where there is one, follows the new text. Null texts stay null.
    """
    words = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs, names))

    def cover(text: str | None, compressor) -> str | None:
        out, at = [], 0
        for s, e, _ in all_spans(text, compressor, ratio):
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = coder(words.value)
        for batch in (b.slice(a, TEXTS_AT_ONCE) for b in batches for a in range(0, len(b), TEXTS_AT_ONCE)):
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array([cover(t.as_py(), compressor) for t in batch.column(i)], pa.string()))

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def digest(spans: list[tuple[int, int, str]]) -> tuple[str, str]:
    """sha256 of the base spans and the list of all spans, as kind:start:end joined by commas."""
    line = lambda xs: ",".join(f"{k}:{s}:{e}" for s, e, k in xs)
    return hashlib.sha256(line([x for x in spans if x[2] != "novel"]).encode()).hexdigest(), line(spans)
