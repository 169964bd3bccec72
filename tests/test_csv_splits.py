"""Large CSV files cut into records by many tasks, against the same files read whole."""

import csv
import os
import random

import pytest

from manchete.sources import csv_splits
from manchete.sources.news_csv import read_news_csv
from manchete.workspace import working_folder


def rows_of(spark, path, **options):
    df = read_news_csv(spark, str(path), row_id="row_id", **options)
    return df.columns, sorted(tuple(r) for r in df.select("row_id", *[c for c in df.columns if c != "row_id"]).collect())


def tricky(seed, n=400):
    """Rows whose cells hold line breaks, quotes, commas, blanks and nothing."""
    rng = random.Random(seed)
    pieces = ["a", "é", " ", "\n", '"', '""', ",", ',"', '",', "\n\n", "linha", "\\", "\t", '\n"', "nan", "x" * 60]
    cell = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))
    return [[cell() or "-", cell(), f"l{k}"] for k in range(n)]


def write(path, rows, end="\n", header=("titulo", "subtitulo", "link_noticia"), before="", **options):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(before)
        w = csv.writer(f, lineterminator=end, **options)
        w.writerow(header)
        w.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("split", [97, 1000])
def test_same_rows_and_ids_as_one_task(spark, tmp_path, seed, split, end):
    rows = tricky(seed, 120 if split < 100 else 400)
    if end == "\r\n":  # a CR LF inside a cell too
        rows[7][0], rows[8][0] = "a\r\nb", "a\r\n\r\n"
    path = tmp_path / "n.csv"
    write(path, rows, end)
    whole = rows_of(spark, path)
    assert len(whole[1]) == len(rows)
    assert rows_of(spark, path, split_bytes=split) == whole


def test_cells_with_lone_quotes_and_carriage_returns(spark, tmp_path):
    """Quotes count only where they begin a cell, so that parity alone would go astray."""
    lines = ['5" disc,a,l1', 'say "x,b,l2', '"q" tail,c,l3', '"two\nlines",d,l4', "cr\rin,e,l5", 'x,"a""\nb""",l6', " \"no,f,l7"]
    path = tmp_path / "n.csv"
    path.write_bytes(("titulo,subtitulo,link_noticia\n" + "\n".join(lines * 40) + "\n").encode())
    assert rows_of(spark, path, split_bytes=50) == rows_of(spark, path)
    assert len(rows_of(spark, path)[1]) == 7 * 40


def test_blank_lines_and_byte_order_mark(spark, tmp_path):
    body = "titulo,link_noticia\na,1\n\nb,2\n\n\n\"c\n\n\nd\",3\n"
    (tmp_path / "plain.csv").write_text(body, encoding="utf-8")
    expected = [("a", "1"), ("b", "2"), ("c\n\n\nd", "3")]
    for k, before in enumerate(["", "\n", "\n\n\n", "﻿", "﻿\n\n", " \t\n", "\n  \n\n \n"]):
        path = tmp_path / f"f{k}.csv"
        path.write_text(before + body, encoding="utf-8")
        for split in (8, csv_splits.SPLIT_BYTES):
            columns, rows = rows_of(spark, path, split_bytes=split)
            assert columns == ["titulo", "link_noticia", "row_id"], (before, split)
            assert [r[1:] for r in rows] == expected, (before, split)
            assert [r[0] for r in rows] == [0, 1, 2]
        path.write_bytes((before + body).replace("\n", "\r\n").encode())
        for split in (8, csv_splits.SPLIT_BYTES):
            assert [r[1:] for r in rows_of(spark, path, split_bytes=split)[1]] == expected, (before, split)


def test_headers_of_many_files(spark, tmp_path):
    """Line breaks in a header cell, blank first lines, lone carriage returns, no rows, nothing at all."""
    (tmp_path / "a.csv").write_text('\n\n"título\ncom quebra",link_noticia\nx,1\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("\nlink_noticia,titulo\n2,t\n", encoding="utf-8")
    (tmp_path / "c.csv").write_bytes(b"titulo,link_noticia\rm,3\rn,4\r")
    (tmp_path / "d.csv").write_text("titulo,vazia\n", encoding="utf-8")
    (tmp_path / "e.csv").write_text("\n\n", encoding="utf-8")
    (tmp_path / "f.csv").write_text("", encoding="utf-8")
    heads = csv_splits.file_heads(spark, str(tmp_path))
    assert [os.path.basename(h.file) for h in heads] == ["a.csv", "b.csv", "c.csv", "d.csv"]
    assert [h.header for h in heads] == [("título\ncom quebra", "link_noticia"), ("link_noticia", "titulo"), ("titulo", "link_noticia"), ("titulo", "vazia")]
    assert [h.one_line for h in heads] == [False, False, True, False]
    for split in (8, csv_splits.SPLIT_BYTES):
        df = read_news_csv(spark, str(tmp_path), row_id="row_id", split_bytes=split)
        assert "vazia" in df.columns and "título\ncom quebra" in df.columns
        found = [(r["titulo"], r["título\ncom quebra"], r["link_noticia"]) for r in df.orderBy("row_id").collect()]
        assert found == [(None, "x", "1"), ("t", None, "2"), ("m", None, "3"), ("n", None, "4")]


def test_only_first_lines_are_read_for_headers(spark, tmp_path):
    """A file is one partition, whose limit ends its reading; a late header takes another round."""
    path = tmp_path / "n.csv"
    path.write_text("titulo,link_noticia\n" + "linha,1\n" * 2000, encoding="utf-8")
    late = tmp_path / "late.csv"
    late.write_text("\n" * 100 + '"titulo' + "\n" * 1500 + 'x",link_noticia\na,1\n', encoding="utf-8")
    session = csv_splits._own_session(spark, files__maxPartitionBytes=1 << 50, files__openCostInBytes=1 << 50)
    limited = csv_splits._lines(session, str(path)).limit(32)
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CollectLimit" in plan or "GlobalLimit" in plan
    assert [len(x) for x in csv_splits._first_lines(session, [str(path), str(late)], 32)] == [32, 32]
    heads = csv_splits.file_heads(spark, str(tmp_path))
    assert [h.header for h in heads] == [("titulo" + "\n" * 1500 + "x", "link_noticia"), ("titulo", "link_noticia")]


def test_many_tasks_read_one_file(spark, tmp_path):
    """A file of several splits: both passes have a task for each, and one record spans many."""
    path = tmp_path / "n.csv"
    rows = [[f"t{k}", "uma linha\n" * (3000 if k == 50 else 3), str(k)] for k in range(400)]
    write(path, rows, quoting=csv.QUOTE_ALL)
    head = csv_splits.file_heads(spark, str(path))[0]
    split = head.size // 20 + 1
    records = csv_splits.split_records(spark, {0: head}, split)
    assert records.count() == 401
    session = csv_splits._own_session(spark, files__maxPartitionBytes=split, files__openCostInBytes=split)
    lines = csv_splits._lines(session, [str(path)])
    assert lines.rdd.getNumPartitions() == 20
    _, found = rows_of(spark, path, split_bytes=split)
    assert [list(r[1:]) for r in found] == rows and [r[0] for r in found] == list(range(400))
    # Only records over an end of a split are shuffled: the long one takes most of them here.
    pieces = spark.read.parquet(*[p for p in [written(spark, head, split)]])
    assert pieces.where("NOT whole").selectExpr("count(DISTINCT record)").first()[0] <= 20


def written(spark, head, split):
    made = []
    original = csv_splits.working_folder

    def folder(s):
        made.append(working_folder(s))
        return made[-1]

    csv_splits.working_folder = folder
    try:
        csv_splits.split_records(spark, {0: head}, split)
    finally:
        csv_splits.working_folder = original
    return made[0]


def test_split_states_of_every_kind(spark):
    """Splits that keep, change or fix the state, with those that keep it left out."""
    kinds = [(0, 1, 0), (10, 0, 1), (20, 1, 0), (30, 1, 1), (40, 0, 1), (50, 0, 0), (60, 0, 1), (70, 1, 0), (80, 0, 1)]
    for first in range(4):
        rows = kinds[first:] + [(k + 100, a, b) for k, a, b in kinds]
        state, wanted = 0, []
        for start, out, inn in rows:
            state = inn if state else out
            wanted += [(3, start, state)] if (out, inn) != (0, 1) else []
        told = [(3, *r) for r in rows if r[1:] != (0, 1)]
        ends = spark.createDataFrame(told, "file long, start long, out_ends long, in_ends long")
        assert sorted(tuple(r) for r in csv_splits.states_after(ends).collect()) == wanted


def test_lines_that_do_not_leave_the_scan_change_no_state(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice(['"', '""', ",", ',"', "a", " "]) for _ in range(rng.randrange(8))) for _ in range(3000)]
    df = spark.createDataFrame([(x.encode(),) for x in lines], "line binary")
    kept = {bytes(r.line) for r in df.where(csv_splits._CHANGES_STATE).collect()}
    left = [x.encode() for x in lines if x.encode() not in kept]
    assert len(left) > 300
    assert all(not csv_splits.ends_inside(x, False) and csv_splits.ends_inside(x, True) for x in left)


def test_a_row_with_too_many_cells_is_refused_in_large_files(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("titulo,link_noticia\n" + "a,1\n" * 50 + "a,1,2\n", encoding="utf-8")
    with pytest.raises(Exception, match="more cells than its header"):
        read_news_csv(spark, str(path), split_bytes=40).collect()
