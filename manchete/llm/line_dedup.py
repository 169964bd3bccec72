"""Repeated lines dropped, found by Bloom filters of lines seen once and seen twice.

Tasks note the hashes of their lines in two filters, one of what was seen and one of what was
seen again. Merging filters keeps that meaning: what two "once" filters share has been seen
twice. Only lines in the final "twice" filter can repeat; only these are shuffled, as
128-bit digests, and counted exactly. A filter lets false candidates through but never
loses a line, so its size decides the shuffle and never the result.

The filters are cut into slices of 2^16 bits, and all bits of a line lie in one slice. Tasks
hand over slices, as lists of bit numbers while they are sparse; a merging task holds one
slice at a time.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from manchete.llm.common import TEXTS_AT_ONCE
from manchete.operators.chunks import chunked_left_join
from manchete.workspace import materialise

BLANKS = b" \t\n\v\f\r"
SLICE_BITS = 1 << 16
_SLICE_BYTES = SLICE_BITS // 8
#: Filter bits for each line, and bits that a line sets.
BITS_A_LINE, HASHES = 12, 3
#: The filters' greatest size in slices (of 8 KB): beyond some 45 million lines they fill
#: up and let more candidates through, which costs the shuffle of 24 bytes for each of
#: them and changes no result.
MOST_SLICES = 1 << 13
#: Hashes that a task gathers before it hands over slices.
_GATHERED = 1 << 18
#: Documents with the same line that a task looks up together, about.
CHUNK_DOCUMENTS = 1 << 14


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without blanks at its ends and with a-z for A-Z, unless it is too short."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def _keys(text: str, min_chars: int) -> set[bytes]:
    found = {line_key(line, min_chars) for line in text.encode().split(b"\n")}
    found.discard(None)
    return found


def _places(hashes: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice of every hash, and the numbers of its bits there, hashes x HASHES."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    shifts = np.arange(HASHES, dtype=np.uint64) * np.uint64(16)
    bits = (hashes[:, None] >> shifts[None, :]) & np.uint64(SLICE_BITS - 1)
    return ((mixed >> np.uint64(32)) % np.uint64(slices)).astype(np.int64), bits.astype(np.uint16)


def _packed(bits: np.ndarray) -> bytes:
    """The bits of a slice: their sorted numbers, or a bitmap if that is shorter."""
    bits = np.unique(bits)
    if 2 * len(bits) < _SLICE_BYTES:
        return bits.astype("<u2").tobytes()
    return _bitmap(bits).tobytes()


def _bitmap(bits: np.ndarray) -> np.ndarray:
    ones = np.zeros(SLICE_BITS, bool)
    ones[bits] = True
    return np.packbits(ones)


def _unpacked(packed: bytes) -> np.ndarray:
    if len(packed) == _SLICE_BYTES:
        return np.frombuffer(packed, np.uint8)
    return _bitmap(np.frombuffer(packed, "<u2"))


def _slices(hashes: np.ndarray, slices: int) -> dict[str, list]:
    """Once and twice filters of some hashes, slice by slice."""
    seen, counts = np.unique(hashes, return_counts=True)
    own, bits = _places(seen, slices)
    order = np.argsort(own, kind="stable")
    own, bits, again = own[order], bits[order], counts[order] > 1
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    rows: dict[str, list] = {"slice": [], "once": [], "twice": []}
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
        rows["slice"].append(int(own[a]))
        rows["once"].append(_packed(bits[a:b].ravel()))
        rows["twice"].append(_packed(bits[a:b][again[a:b]].ravel()))
    return rows


def twice_filter(df: DataFrame, text: str, min_chars: int, slices: int) -> np.ndarray:
    """The filter of keys seen twice, slices x bytes: every key that two rows hold is in it."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = array("Q")

        def out() -> pa.RecordBatch:
            made = _slices(np.array(held, np.uint64), slices)
            del held[:]
            types = {"slice": pa.int32(), "once": pa.binary(), "twice": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(made[k], t) for k, t in types.items()], names=list(types))

        for batch in batches:
            for body in batch.column("text"):
                held.extend(xxhash.xxh3_64_intdigest(k) for k in _keys(body.as_py(), min_chars))
                if len(held) >= _GATHERED:
                    yield out()
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by slice, so that one slice is held at a time."""
        at, once, twice = None, None, None
        shown = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["slice", "twice"])
        for batch in batches:
            for number, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at:
                    if at is not None and twice.any():
                        yield shown()
                    at, once, twice = number, np.zeros(_SLICE_BYTES, np.uint8), np.zeros(_SLICE_BYTES, np.uint8)
                more = _unpacked(a)
                twice = twice | _unpacked(b) | (once & more)
                once = once | more
        if at is not None and twice.any():
            yield shown()

    source = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = source.mapInArrow(gather, "slice int, once binary, twice binary")
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    found = np.zeros((slices, _SLICE_BYTES), np.uint8)
    for row in merged.collect():  # MOST_SLICES rows at most
        found[row["slice"]] = np.frombuffer(row["twice"], np.uint8)
    return found


def in_filter(filter: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    own, bits = _places(hashes, len(filter))
    bytes_ = filter[own[:, None], bits >> 3]
    return ((bytes_ >> (7 - (bits & 7)).astype(np.uint8)) & 1).all(axis=1)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _slices_for(df: DataFrame, text: str) -> int:
    """Slices for all lines of the table, counted without looking at their lengths."""
    body = F.coalesce(F.col(text), F.lit(""))
    breaks = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit("")))
    lines = df.agg(F.coalesce(F.sum(breaks + 1), F.lit(0))).first()[0]
    return min(MOST_SLICES, lines * BITS_A_LINE // SLICE_BITS + 1)


def drop_repeated_lines(
    df: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """The rows of `df` with repeated lines dropped from `text`, and `n_lines`, `n_dropped`.

    A text is split at line feeds; null and empty texts are one empty line, and the text of
    a result is never null. A line's key is the line without `[\\x20\\x09-\\x0D]` at its
    ends and with a-z for A-Z. Keys of `min_chars` code points or more that `min_docs`
    documents or more hold lose all their lines but those in the document with the largest
    id that holds it, where all of them stay. Rows with the same id are one document, from
    each of which the same keys go. A row without id is no document that counts: it makes
    nothing repeat and loses nothing. `n_lines` counts lines before dropping. All columns
    are kept; those called `n_lines` or `n_dropped` are replaced. An empty table gives an
    empty result.
    """
    df = df.drop("n_lines", "n_dropped")
    columns = df.columns
    # Own names for all columns, so that none of them can clash.
    place = {c: f"c{k}" for k, c in enumerate(columns)}
    own = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c == text else F.col(f"`{c}`") for c in columns}
    source = df.select(*[own[c].alias(place[c]) for c in columns])
    key, body = place[id], place[text]
    counted = source.where(F.col(key).isNotNull())
    filter = twice_filter(counted, body, min_chars, _slices_for(counted, body))
    shared = source.sparkSession.sparkContext.broadcast(filter)

    schema = T.StructType([*source.schema, *T.StructType.fromDDL("lines long, suspects array<binary>")])
    arrow = to_arrow_schema(schema)

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                lists, lines = [], []
                for t in part.column(body):
                    t = t.as_py()
                    lists.append(list(_keys(t, min_chars)))
                    lines.append(t.count("\n") + 1)
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for keys in lists for k in keys], np.uint64)
                hits = iter(in_filter(shared.value, hashes).tolist())
                # Only as many hits as a text has keys are taken for it.
                found = [[_digest(k) for k in keys if next(hits)] for keys in lists]
                made = {"lines": lines, "suspects": found}
                columns = [pa.array(made[f.name], f.type) if f.name in made else part.column(f.name).cast(f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    checked = materialise(source.mapInArrow(suspect, schema))
    known = F.col(key).isNotNull() & (F.size("suspects") > 0)
    pairs = checked.where(known).select(F.col(key).alias("doc"), F.explode("suspects").alias("digest")).distinct()
    pairs = materialise(pairs)
    held = pairs.groupBy("digest").agg(F.max("doc").alias("last"), F.count("*").alias("docs"))
    repeated = held.where(F.col("docs") >= min_docs).drop("docs")
    met = chunked_left_join(pairs, repeated, "digest", spread_by=["doc"], chunk_rows=CHUNK_DOCUMENTS)
    drops = met.where(F.col("doc") < F.col("last")).groupBy("doc").agg(F.collect_list("digest").alias("drops"))
    usual = checked.where(~known).withColumn("n_dropped", F.lit(0).cast("long")).drop("suspects")
    touched = checked.where(known).drop("suspects").join(drops, F.col(key) == F.col("doc"), "left").drop("doc")
    result = usual.unionByName(_without_lines(touched, body, min_chars))
    return result.select(*[F.col(place[c]).alias(c) for c in columns], F.col("lines").alias("n_lines"), "n_dropped")


def _without_lines(df: DataFrame, text: str, min_chars: int) -> DataFrame:
    """Rows of `df` without the lines whose digests `drops` lists, and how many went."""
    schema = T.StructType([*df.drop("drops").schema, T.StructField("n_dropped", T.LongType())])
    arrow = to_arrow_schema(schema)

    def kept(body: str, drops: list[bytes] | None) -> tuple[str, int]:
        if not drops:
            return body, 0
        gone, lines = set(drops), body.encode().split(b"\n")
        keys = (line_key(line, min_chars) for line in lines)
        left = [line for line, k in zip(lines, keys, strict=True) if k is None or _digest(k) not in gone]
        return b"\n".join(left).decode(), len(lines) - len(left)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                bodies, drops = part.column(text).to_pylist(), part.column("drops").to_pylist()
                made = [kept(*x) for x in zip(bodies, drops, strict=True)]
                new = {text: [m[0] for m in made], "n_dropped": [m[1] for m in made]}
                columns = [pa.array(new[f.name], f.type) if f.name in new else part.column(f.name).cast(f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(strip, schema)
