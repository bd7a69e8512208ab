"""Quoted tables read block by block against a sequential reader."""

import csv
import io
import random

import pytest

from tokenmill.sources import quoted, readers


def sequential(text, width):
    """All records, read by one pass over the text; blank lines between records don't count."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), strict=False) if r]
    return [tuple((r + [""] * width)[:width]) for r in rows]


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)
    spark.conf.unset("spark.sql.files.minPartitionNum")


def write(rows, ends="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=ends).writerows(rows)
    return out.getvalue()


def read(spark, path, width=3):
    table = readers.quoted_csv(spark, str(path), [f"c{i}" for i in range(width)], multi_line=True)
    return [tuple(r)[:-1] for r in sorted(table.collect(), key=lambda r: r["line_no"])], sorted(r["line_no"] for r in table.collect())


def test_two_blocks(spark, tmp_path, small_blocks):
    text = write([("a", 'say ""hi""\n\nand "', "x"), ("b", 'over\nthe\n"cut"\n,\n' + "z\n" * 30, '"'), ("c", "", "\n")])
    (tmp_path / "t.csv").write_text(text, newline="")
    small_blocks(len(text) // 2 + 1)
    records = quoted.quoted_records(spark, str(tmp_path / "t.csv"))
    assert spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() == 2 and records.count() == 3
    rows, numbers = read(spark, tmp_path / "t.csv")
    assert rows == sequential(text, 3) and numbers == [0, 1, 2]


@pytest.mark.parametrize("size", [7, 40, 300, 1 << 20])
def test_random_tables(spark, tmp_path, small_blocks, size):
    rng = random.Random(size)
    field = lambda: "".join(rng.choice(['"', "\n", ",", "a", "bc", " ", "é", "\n\n", '""']) for _ in range(rng.randrange(8)))
    want = []
    for part in range(3):  # several files, one without a last line end
        rows = [(f"r{part}", field(), field()) for _ in range(rng.randrange(1, 25))]
        text = write(rows)
        (tmp_path / f"part-{part}.csv").write_text(text if part else text[:-1], newline="")
        want += sequential(text, 3)
    small_blocks(size)
    rows, numbers = read(spark, tmp_path)
    assert rows == want and numbers == list(range(len(want)))


def test_line_ends_plain_fields_and_blank_lines(spark, tmp_path, small_blocks):
    text = 'a,b"c,d\r\n\r\n"x\r\ny",,"1 ""2"""\r\n\n,"",\n'
    (tmp_path / "t.csv").write_text(text, newline="")
    for size in (3, 11, 1000):
        small_blocks(size)
        rows, numbers = read(spark, tmp_path / "t.csv")
        assert rows == [("a", 'b"c', "d"), ("x\r\ny", "", '1 "2"'), ("", "", "")] and numbers == [0, 1, 2]


def test_one_record_over_many_blocks_and_an_open_field(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('1,"' + "line\n" * 200 + '",2\n3,4,5\n', newline="")
    (tmp_path / "bb.csv").write_text('6,7,"never\nclosed\n', newline="")
    small_blocks(50)
    rows, numbers = read(spark, tmp_path)
    assert rows[:2] == [("1", "line\n" * 200, "2"), ("3", "4", "5")] and numbers == [0, 1, 2] and rows[2][:2] == ("6", "7") and rows[2][2].startswith("never\nclosed")


def test_empty_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\n\n")
    assert read(spark, tmp_path / "t.csv") == ([], [])
