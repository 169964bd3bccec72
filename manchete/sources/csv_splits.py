"""Headers and records of CSV files whose cells may hold line breaks.

A line feed ends a record only outside quotes, and whether a place is inside quotes depends
on everything before it in the file. So a large file is read twice. First every split tells
how it ends if it begins outside quotes, and if it begins inside, for which only the lines
that can change the state leave the scan; putting these together in the order of the splits
gives the state in which each really begins. Then every split cuts its lines into records,
and only the records that reach over an end of a split, at most two for each, are shuffled
to be glued.
"""

from __future__ import annotations

import csv
import io
from bisect import bisect_left
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import pairwise
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import manchete
from manchete.workspace import working_folder

# Ship the rules with the tasks, so executors need no installed package.
cloudpickle.register_pickle_by_value(manchete)

#: Larger files are read by several tasks, each of which takes so many bytes.
SPLIT_BYTES = 64 << 20
#: Lines of a file that are read for its header at first, and bytes of a line.
_HEAD_LINES, _LINE_BYTES = 32, 1 << 20
#: Files whose first lines are read in one job, and such jobs at a time.
_HEAD_FILES, _HEAD_JOBS = 64, 8
_MARK = b"\xef\xbb\xbf"
#: A result batch holds so many records, or characters.
_BATCH_RECORDS, _BATCH_CHARS = 4096, 4 << 20


@dataclass(frozen=True)
class Head:
    """A file with its column names."""

    file: str
    size: int
    header: tuple[str, ...]
    #: CR LF ends its first line, so that it counts as a line feed everywhere.
    crlf: bool
    #: Lone carriage returns end its rows: it has no lines to split.
    one_line: bool
    #: Lines of blanks that stand before the header, empty lines not counted.
    blanks: int


def _own_session(spark: SparkSession, **settings: object) -> SparkSession:
    """A session with the settings of ``spark`` but those given, which leaves ``spark`` alone."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.get(key, None) != value:
            session.conf.set(key, value)
    for key, value in settings.items():
        session.conf.set(f"spark.sql.{key.replace('__', '.')}", str(value))
    return session


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines as bytes, ended by line feeds alone."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


# Other lines end as they begin: no cell begins with a quote, and all quotes are doubled.
_CHANGES_STATE = """startswith(line, X'22') OR contains(line, X'2C22') OR contains(replace(CAST(line AS STRING), '""', ''), '"')"""


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether the place after a line is inside quotes, given the place before it.

    Quotes count where they begin a cell. A quote inside ends the quotes unless another
    follows; what comes between it and the next comma belongs to the cell.
    """
    if inside and 2 * line.count(b'""') == line.count(b'"'):
        return True
    at = 0
    while True:
        if not inside:
            if not line.startswith(b'"', at):
                comma = line.find(b',"', at)
                if comma < 0:
                    return False
                at = comma + 1
            at += 1
        quote = line.find(b'"', at)
        while quote >= 0 and line.startswith(b'"', quote + 1):
            quote = line.find(b'"', quote + 2)
        if quote < 0:
            return True
        comma = line.find(b",", quote + 1)
        if comma < 0:
            return False
        at, inside = comma + 1, False


def _first_lines(session: SparkSession, files: list[str], lines: int) -> list[list[bytes]]:
    """Up to ``lines`` first lines of each file, each cut off at a megabyte.

    A file is one partition of ``session``, so its limit ends the reading of it.
    """
    tables = [
        _lines(session, unquote(file)).limit(lines).select(
            F.lit(k).alias("file"), F.monotonically_increasing_id().alias("at"), F.substring("line", 1, _LINE_BYTES).alias("line")
        )
        for k, file in enumerate(files)
    ]
    while len(tables) > 1:  # in pairs, so that no plan is deep
        tables = [a.unionAll(b) for a, b in zip(tables[::2], tables[1::2], strict=False)] + tables[len(tables) // 2 * 2 :]
    found: list[list[bytes]] = [[] for _ in files]
    for r in sorted(tables[0].collect(), key=lambda r: (r["file"], r["at"])):
        found[r["file"]].append(bytes(r["line"]))
    return found


def _head(file: str, size: int, lines: list[bytes], complete: bool) -> Head | None:
    """What the first lines tell of a file, if they hold a whole header; ``complete``: there are no more lines."""
    crlf = lines[0].endswith(b"\r")
    held: list[bytes] = []
    inside, blanks = False, 0
    for line in lines:
        line = line.removesuffix(b"\r") if crlf else line
        line = line if line is not lines[0] else line.removeprefix(_MARK)
        if not held and not line.strip(b" \t"):
            blanks += line != b""
            continue
        held.append(line)
        inside = ends_inside(line, inside)
        if not inside:
            break
    if not complete and (inside or not held):
        return None
    # Where lone carriage returns end the rows, all of them are one line here.
    rows = csv.reader(io.StringIO(b"\n".join(held).decode("utf-8", "replace"), newline=""))
    header, one_line = tuple(next(rows, ())), next(rows, None) is not None
    return Head(file, size, header, crlf, one_line, blanks)


def file_heads(spark: SparkSession, paths: str | list[str]) -> list[Head]:
    """Every file with its column names, in the order of the paths; files without a record are left out.

    The header is the first record that does not begin with a blank line. Only the first
    lines of a file are read, and more of them only where they hold no whole header. The
    list of files is in the driver's hands anyway.
    """
    listed = spark.read.format("binaryFile").load(paths).select("_metadata.file_path", "_metadata.file_size")
    open_ = {file: size for file, size in sorted(listed.collect()) if size}
    large = 1 << 50  # no file is split, and none shares a partition
    session = _own_session(spark, files__maxPartitionBytes=large, files__openCostInBytes=large)
    heads: list[Head] = []
    lines = _HEAD_LINES
    while open_:
        files = list(open_)
        batches = [files[k : k + _HEAD_FILES] for k in range(0, len(files), _HEAD_FILES)]
        with ThreadPoolExecutor(_HEAD_JOBS) as pool:
            found = pool.map(lambda batch, n=lines: _first_lines(session, batch, n), batches)
            for file, first in ((f, x) for batch, rows in zip(batches, found, strict=True) for f, x in zip(batch, rows, strict=True)):
                head = _head(file, open_[file], first, len(first) < lines) if first else None
                heads += [head] if head else []
                if head or not first:
                    del open_[file]
        lines *= _HEAD_LINES
    return sorted((h for h in heads if h.header), key=lambda h: h.file)


def _runs(batches: Iterator[pa.RecordBatch], crlf: dict[int, bool]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Lines of the same file and split that come together, without the CR of a CR LF.

    The mark before a file's first line goes as well.
    """
    at = None
    for batch in batches:
        files, starts = (batch.column(c).to_numpy() for c in ("file", "start"))
        lines = batch.column("line").to_pylist()
        edges = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
        for a, b in pairwise([0, *edges.tolist(), len(lines)]):
            file, start, own = int(files[a]), int(starts[a]), lines[a:b]
            if start == 0 and at != (file, start):
                own[0] = own[0].removeprefix(_MARK)
            at = (file, start)
            yield file, start, [line.removesuffix(b"\r") for line in own] if crlf[file] else own


def _split_ends(lines: DataFrame, crlf: dict[int, bool]) -> DataFrame:
    """(file, start, out_ends, in_ends): how a split ends that begins outside, or inside, quotes (1: inside)."""
    names = ["file", "start", "out_ends", "in_ends"]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int], tuple[bool, bool]] = {}
        for file, start, own in _runs(batches, crlf):
            outside, inside = states.get((file, start), (False, True))
            for line in own:
                outside, inside = ends_inside(line, outside), ends_inside(line, inside)
            states[file, start] = outside, inside
        if states:
            columns = zip(*((*at, *map(int, ending)) for at, ending in states.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return lines.where(_CHANGES_STATE).mapInArrow(ends, ", ".join(f"{n} long" for n in names))


def states_after(ends: DataFrame) -> DataFrame:
    """(file, start, inside): the state after each split of ``ends`` (1: inside quotes).

    A split keeps the state, changes it, or ends in one state whatever it began with. The
    state after a split is that of the last one of the third kind, changed as often as
    splits since then change it. Splits that ``ends`` lacks keep it. A file's window has a
    row for each of its splits at most.
    """
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = F.col("out_ends") == F.col("in_ends")
    changes = F.sum(F.when(~fixed, F.col("out_ends")).otherwise(0)).over(upto)
    counted = ends.withColumn("changes", changes).withColumn("anchor", F.when(fixed, F.col("out_ends") + F.col("changes")))
    last = F.coalesce(F.last("anchor", ignorenulls=True).over(upto), F.lit(0).cast("long"))
    return counted.select("file", "start", F.pmod(last + F.col("changes"), F.lit(2)).alias("inside"))


def _pieces(lines: DataFrame, crlf: dict[int, bool], known: Broadcast) -> DataFrame:
    """(file, start, record, whole, text): records, and the parts of those that splits cut.

    Records count from 1 in their split; what a split begins with, if that belongs to a
    record begun before it, counts as 0. ``known`` has for a file the splits whose state
    after them is known, in order, and these states.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at, held, inside, record, chars = None, [], False, 0, 0

        def out() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=["file", "start", "record", "whole", "text"])

        def close(ended: bool) -> int:
            text = b"\n".join(held).decode("utf-8", "replace")
            held.clear()
            rows.append((*at, record, ended and record > 0, text))
            return len(text)

        for file, start, own in _runs(batches, crlf):
            if (file, start) != at:
                if held:
                    close(False)
                at, record = (file, start), 0
                starts, states = known.value.get(file, ((), ()))
                earlier = bisect_left(starts, start)
                inside = earlier > 0 and states[earlier - 1]
            for line in own:
                if not inside:
                    if not line:
                        continue
                    record += 1
                held.append(line)
                if b'"' in line:
                    inside = ends_inside(line, inside)
                if not inside:
                    chars += close(True)
                    if len(rows) >= _BATCH_RECORDS or chars >= _BATCH_CHARS:
                        yield out()
                        chars = 0
        if held:
            close(False)
        if rows:
            yield out()

    return lines.mapInArrow(cut, "file long, start long, record long, whole boolean, text string")


def split_records(spark: SparkSession, heads: dict[int, Head], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(number, record, text): all records of the files, each of which has its number.

    Records count from 0. Empty lines outside quotes are no records, but lines of blanks
    are, also before the header. Both passes run here, with the same splits; the records
    are written to the working folder, from where the table is read.
    """
    session = _own_session(spark, files__maxPartitionBytes=split_bytes, files__openCostInBytes=split_bytes)
    # A file goes by a hash of its path, which is shorter; no two may share one.
    paths = session.createDataFrame([(h.file, n) for n, h in heads.items()], "path string, number long")
    keys = {r["number"]: r["file"] for r in paths.select("number", F.xxhash64("path").alias("file")).collect()}
    if len(set(keys.values())) < len(keys):
        raise ValueError("two CSV files have paths with the same hash; read them apart")
    crlf = {keys[n]: h.crlf for n, h in heads.items()}
    lines = _lines(session, [unquote(h.file) for h in heads.values()])
    lines = lines.select(F.xxhash64("file").alias("file"), "start", "line")
    # What follows has a row for each split, as many as the driver keeps of any scan.
    known: dict[int, tuple[list[int], list[bool]]] = {}
    for r in sorted(states_after(_split_ends(lines, crlf)).collect()):
        starts, states = known.setdefault(r["file"], ([], []))
        starts.append(r["start"]), states.append(r["inside"] == 1)
    path = working_folder(spark)
    _pieces(lines, crlf, spark.sparkContext.broadcast(known)).write.parquet(path)
    pieces = spark.read.schema("file long, start long, record long, whole boolean, text string").parquet(path)
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    held = pieces.groupBy("file", "start").agg(F.max("record").alias("held"))
    before = held.withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0))).drop("held")
    numbers = spark.createDataFrame([(k, n) for n, k in keys.items()], "file long, number long")
    numbered = pieces.join(F.broadcast(before.join(F.broadcast(numbers), "file")), ["file", "start"])
    numbered = numbered.select("number", (F.col("before") + F.col("record") - 1).alias("record"), "start", "whole", "text")
    # Parts of a record: one for each split that it touches.
    parts = F.sort_array(F.collect_list(F.struct("start", "text")))["text"]
    glued = numbered.where("NOT whole").groupBy("number", "record").agg(F.array_join(parts, "\n").alias("text"))
    return numbered.where("whole").select("number", "record", "text").unionByName(glued)
