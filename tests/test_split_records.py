"""Splittable records and archive blocks against readers that see a file whole."""

from __future__ import annotations

import csv
import io
import random

import pytest

from contraluz.sources import archives, delimited, records
from tests_support import make_zip


def body(rows, end="\n"):
    text = io.StringIO(newline="")
    csv.writer(text, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator=end).writerows(rows)
    return text.getvalue().encode()


def random_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "bc", '"', '""', "\n", "\n\n", ";", "ção", " ", "x" * 40, "linha\nlinha\n"]
    return [[str(i), "".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))] for i in range(n)]


@pytest.fixture
def split_at(spark):
    """Let Spark cut files into ranges of so many bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]

    def at(size):
        for name, value in zip(names, (size, 1), strict=True):
            spark.conf.set(name, str(value))

    yield at
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_give_whole_records(spark, tmp_path, split_at, size, end):
    rows = {name: random_rows(seed) for seed, name in enumerate(("a.csv", "b.csv", "c.csv"))}
    rows["c.csv"] = [["0", "q\n" * 400 + '"'], ["1", "plain"], ["2", "z\n" * 300]]  # over many ranges
    for name, found in rows.items():
        (tmp_path / name).write_bytes(body(found, end))
    split_at(size)
    got = delimited.read_split(spark, str(tmp_path), ["id", "texto"])
    want = [(i, t or None) for found in rows.values() for i, t in found]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_ranges_are_many(spark, tmp_path, split_at):
    (tmp_path / "a.csv").write_bytes(body(random_rows(5, 300)))
    split_at(64)
    found = records.quote_parity(records._lines(spark, str(tmp_path)))
    assert len(found) > 20 and any(before for before, _ in found.values())


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_files_with_headers(spark, tmp_path, split_at, size):
    for name, first in (("202501_Compras.csv", 0), ("202502_Compras.csv", 100)):
        rows = [["ID", "RAZÃO"], *[[str(first + int(i)), t] for i, t in random_rows(first, 30)]]
        (tmp_path / name).write_bytes(b"\xef\xbb\xbf" + body(rows) if first else body(rows))
    split_at(size)
    got = delimited.with_period(delimited.read_split(spark, str(tmp_path)))
    assert got.columns == ["ID", "RAZÃO", "_arquivo", "competencia"]
    want = [
        (str(first + int(i)), t or None, month)
        for month, first in (("202501", 0), ("202502", 100)) for i, t in random_rows(first, 30)
    ]
    rows = got.select("ID", "RAZÃO", "competencia").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    (tmp_path / "other.csv").write_bytes(body([["X"], ["1"]]))
    with pytest.raises(ValueError, match="one header"):
        delimited.read_split(spark, str(tmp_path))


def test_mixed_charsets_blank_lines_and_ragged_records(spark, tmp_path, split_at):
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "a").write_bytes(b'"1";"p\xe3o\np\xc3\xa3o \x80"\r\n\n\r\n"2";"x"\n"3";""')
    split_at(9)
    got = delimited.read_split(spark, str(folder), ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [("1", "pão\npÃ£o €"), ("2", "x"), ("3", None)]
    (folder / "b").write_bytes(b'"1";"2";"3"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        delimited.read_split(spark, str(folder), ["a", "b"]).collect()


def test_an_unbalanced_quote_is_an_error(spark, tmp_path, split_at):
    (tmp_path / "a").write_bytes(b'"1"\n"2\n"3"\n')
    split_at(4)
    with pytest.raises(ValueError, match="unbalanced"):
        delimited.read_split(spark, str(tmp_path), ["a"])


def test_no_rows(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"")
    (tmp_path / "b").write_bytes(b"\n\n")
    assert delimited.read_split(spark, str(tmp_path), ["a"]).count() == 0


# archives


@pytest.mark.parametrize("size", [1, 16, 300, 1 << 22])
def test_blocks_give_the_records_of_the_member(spark, tmp_path, size):
    members = {f"{n}.csv": body(random_rows(n), end) for n, end in ((1, "\n"), (2, "\r\n"))}
    members["empty.csv"], members["bom.csv"] = b"", b"\xef\xbb\xbf" + body([["9", "x"]]).rstrip()
    paths = [make_zip(tmp_path / "a.zip", members), make_zip(tmp_path / "b.zip", {"other.txt": b"x", "b.CSV": b'"7";"y"'})]
    want = archives.zip_records(spark, paths, ".csv").select("archive", "member", "record")
    got = archives.zip_block_records(spark, paths, ".csv", block_bytes=size)
    assert sorted(map(str, got.select("archive", "member", "record").collect())) == sorted(map(str, want.collect()))
    assert got.filter("first").count() == 4
    one, two = (read(spark, paths, ["a", "b"], ".csv") for read in (archives.zip_headerless, archives.zip_block_headerless))
    assert sorted(map(str, two.collect())) == sorted(map(str, one.collect()))


def test_blocks_with_headers_and_errors(spark, tmp_path):
    head = "\"A\";\"RAZ\xc3O\"\r\n".encode("latin-1")
    path = make_zip(tmp_path / "a.zip", {"m1.csv": head + b'"1";"x\ny"\r\n', "m2.csv": head + '"2";"ção"'.encode()})
    got = archives.zip_block_with_header(spark, [path], "m")
    assert sorted(map(tuple, got.drop("_arquivo").collect())) == [("1", "x\ny"), ("2", "ção")]
    bad = make_zip(tmp_path / "b.zip", {"m.csv": b'"1"\n"2\n'})
    with pytest.raises(Exception, match="unbalanced"):
        archives.zip_block_records(spark, [bad]).collect()
    long = make_zip(tmp_path / "c.zip", {"m.csv": b'"1"\n"2222222222"\n'})
    with pytest.raises(Exception, match="longer than 5 bytes"):
        archives.zip_block_records(spark, [long], block_bytes=2, max_record=5).collect()
    assert archives.zip_block_records(spark, [bad], "nothing").count() == 0
