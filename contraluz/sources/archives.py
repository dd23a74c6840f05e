"""Delimited files inside ZIP archives.

A compressed member cannot be split, so one member is one partition; it is streamed, never
unpacked to disk or held whole. Readers by block leave only that to the member's task: it cuts the
inflated bytes into blocks between two records, and records are cut, repaired and parsed by built-ins
after the blocks are dealt to all tasks. Readers by record do the cutting in the member's task. Rewrite
big archives as tables once.
"""

from __future__ import annotations

import io
import json
import sys
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from contraluz.functions.charset import repair_record
from contraluz.sources.delimited import header_names, parse_record

# Ship the reader itself to the executors, so this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
BATCH_BYTES = 4 << 20
# A record this long means an unbalanced quote; failing is better than swallowing the member.
MAX_RECORD = 64 << 20
SCHEMA = "archive string, member string, number bigint, record binary"
_ARROW = pa.schema(
    [
        ("archive", pa.string()),
        ("member", pa.string()),
        ("number", pa.int64()),
        ("record", pa.binary()),
    ]
)


@dataclass
class Member(InputPartition):
    archive: str
    member: str


def _open(path: str) -> zipfile.ZipFile:
    """Open an archive on any filesystem the path or URI names."""
    if path.startswith("file:"):  # Spark lists local files as file:/a/b
        path = unquote(urlsplit(path).path)
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return zipfile.ZipFile(io.BufferedReader(system.open_input_file(inner), CHUNK))


def _lines(stream) -> Iterator[bytes]:
    held, size, first = [], 0, True
    while chunk := stream.read(CHUNK):
        if first:
            chunk, first = chunk.removeprefix(BYTE_ORDER_MARK), False
        *whole, rest = chunk.split(b"\n")
        if whole:
            yield b"".join([*held, whole[0]])
            yield from whole[1:]
            held, size = [], 0
        held.append(rest)
        size += len(rest)
        if size > MAX_RECORD:
            raise ValueError(f"line longer than {MAX_RECORD} bytes")
    if last := b"".join(held):
        yield last


def _records(stream) -> Iterator[bytes]:
    """Lines, joined while a quoted field is still open. Quotes are the same byte in all charsets."""
    held, size = [], 0
    open_quote = False
    for line in _lines(stream):
        held.append(line)
        size += len(line)
        open_quote ^= line.count(b'"') % 2 == 1
        if size > MAX_RECORD:
            raise ValueError(f"record longer than {MAX_RECORD} bytes: unbalanced quote?")
        if not open_quote:
            record = b"\n".join(held).removesuffix(b"\r")
            if record:
                yield record
            held, size = [], 0
    if held:
        raise ValueError("the last record has an unbalanced quote")


class ZipRecordsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.archives = json.loads(options["archives"])
        self.wanted = options.get("member", "").lower()
        self.only_first = options.get("only_first", "false") == "true"

    def partitions(self) -> list[Member]:
        found = []
        for archive in self.archives:
            with _open(archive) as unzipped:
                found += [
                    Member(archive, info.filename)
                    for info in unzipped.infolist()
                    if not info.is_dir()
                    and self.wanted in info.filename.rsplit("/", 1)[-1].lower()
                ]
        return found

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        with _open(partition.archive) as unzipped, unzipped.open(partition.member) as stream:
            batch, size, first = [], 0, 0
            for record in _records(stream):
                if self.only_first:
                    yield self._batch(partition, [record], 0)
                    return
                batch.append(record)
                size += len(record)
                if size >= BATCH_BYTES:
                    yield self._batch(partition, batch, first)
                    first += len(batch)
                    batch, size = [], 0
            if batch:
                yield self._batch(partition, batch, first)

    @staticmethod
    def _batch(partition: Member, records: list[bytes], first: int) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([partition.archive] * n),
                pa.array([partition.member] * n),
                pa.array(range(first, first + n), pa.int64()),
                pa.array(records, pa.binary()),
            ],
            schema=_ARROW,
        )


class ZipRecords(DataSource):
    """Records of the members of ZIP archives as bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipRecordsReader(self.options)


def _record_end(data: bytes) -> int:
    """Where the last whole record ends: after a line break with an even number of quotes before it."""
    at, odd = len(data), data.count(b'"') % 2
    while (line := data.rfind(b"\n", 0, at)) >= 0:
        odd ^= data.count(b'"', line, at) % 2
        if not odd:
            return line + 1
        at = line
    return 0


def _blocks(stream, size: int, max_record: int) -> Iterator[bytes]:
    """Inflated bytes in blocks of about ``size``, each of whole records."""
    held = stream.read(len(BYTE_ORDER_MARK)).removeprefix(BYTE_ORDER_MARK)
    while chunk := stream.read(size):
        held += chunk
        if end := _record_end(held):
            yield held[:end]
            held = held[end:]
        if len(held) > max_record:
            raise ValueError(f"record longer than {max_record} bytes: unbalanced quote?")
    if held.count(b'"') % 2:
        raise ValueError("the last record has an unbalanced quote")
    if held:
        yield held


class ZipBlocksReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.members = [Member(*m) for m in json.loads(options["members"])]
        self.size, self.max_record = int(options["size"]), int(options["maxrecord"])

    def partitions(self) -> list[Member]:
        return self.members

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        with _open(partition.archive) as unzipped, unzipped.open(partition.member) as stream:
            for number, block in enumerate(_blocks(stream, self.size, self.max_record)):
                yield ZipRecordsReader._batch(partition, [block], number)


class ZipBlocks(DataSource):
    """Blocks of whole records of the members of ZIP archives as bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipBlocksReader(self.options)


def zip_members(spark: SparkSession, archives: Sequence[str], member: str = "") -> list[tuple[str, str]]:
    """(archive, member) of the members whose name contains ``member`` (any case), listed by tasks."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with _open(archive) as unzipped:
                    names = [
                        info.filename
                        for info in unzipped.infolist()
                        if not info.is_dir() and member.lower() in info.filename.rsplit("/", 1)[-1].lower()
                    ]
                yield pa.record_batch([pa.array([archive] * len(names), pa.string()), pa.array(names, pa.string())], ["a", "m"])

    paths = spark.createDataFrame([(a,) for a in archives], "a string").repartition(len(archives), "a")
    return sorted((row["a"], row["m"]) for row in paths.mapInArrow(listed, "a string, m string").collect())


# stands for a line break between records; no ISO-8859-1 text has it
_BREAK = "\ue000"


def records_of_block(block: Column) -> Column:
    """The records of a block as bytes: it is cut at line breaks outside quotes, by built-ins.

    Cut at the quotes first, every second part is outside; only there a line break ends a record.
    """
    parts = F.split(F.decode(block, "ISO-8859-1"), '"', -1)
    marked = F.transform(
        parts, lambda p, i: F.when(i % 2 == 0, F.translate(p, "\n", _BREAK)).otherwise(p)
    )
    return F.split(F.array_join(marked, '"'), _BREAK, -1)


def zip_block_records(
    spark: SparkSession,
    archives: Sequence[str],
    member: str = "",
    block_bytes: int = BATCH_BYTES,
    max_record: int = MAX_RECORD,
) -> DataFrame:
    """``(archive, member, first, record)`` of the matching members; ``first`` is a member's first record.

    A record of more than ``max_record`` bytes means an unbalanced quote and is an error.
    """
    spark.dataSource.register(ZipBlocks)
    members = zip_members(spark, archives, member)
    if not members:
        return spark.createDataFrame([], "archive string, member string, first boolean, record binary")
    blocks = (
        spark.read.format("zip_blocks")
        .option("members", json.dumps(members))
        .option("size", block_bytes)
        .option("maxrecord", max_record)
        .load()
        .repartition("archive", "member", "number")
    )
    cut = F.posexplode(records_of_block(F.col("record"))).alias("place", "text")
    return (
        blocks.select("archive", "member", "number", cut)
        .filter(~F.col("text").isin("", "\r"))
        .select(
            "archive",
            "member",
            ((F.col("number") == 0) & (F.col("place") == 0)).alias("first"),
            F.encode(F.regexp_replace("text", r"\r\z", ""), "ISO-8859-1").alias("record"),
        )
    )


def zip_block_headerless(
    spark: SparkSession, archives: Sequence[str], names: Sequence[str], member: str = ""
) -> DataFrame:
    """As :func:`zip_headerless`, read by block."""
    records = zip_block_records(spark, archives, member)
    return records.select(parse_record(repair_record(F.col("record")), names).alias("r")).select("r.*")


def zip_block_with_header(
    spark: SparkSession, archives: Sequence[str], member: str = ""
) -> DataFrame:
    """As :func:`zip_with_header`, read by block."""
    # of each member only the first record is read for its header
    heads = zip_records(spark, archives, member, only_first=True)
    names = _one_header(heads, member)
    records = zip_block_records(spark, archives, member)
    parsed = parse_record(repair_record(F.col("record")), names)
    return (
        records.filter(~F.col("first"))
        .select(parsed.alias("r"), F.concat_ws("/", "archive", "member").alias("_arquivo"))
        .select("r.*", "_arquivo")
    )


def _one_header(firsts: DataFrame, member: str) -> list[str]:
    headers = firsts.select(F.decode("record", "ISO-8859-1").alias("h")).distinct()
    # one spelling in the reference charset and one in another may stand for the same names
    found = {tuple(header_names(row["h"])) for row in headers.toLocalIterator()}
    if len(found) != 1:
        raise ValueError(f"expected one header in members like {member!r}, found {len(found)}")
    return list(found.pop())


def zip_records(
    spark: SparkSession, archives: Sequence[str], member: str = "", only_first: bool = False
) -> DataFrame:
    """Raw records of the members whose name contains ``member`` (any case).

    ``only_first`` stops after the first record of each member, to look at headers.
    """
    spark.dataSource.register(ZipRecords)
    return (
        spark.read.format("zip_records")
        .option("archives", json.dumps(list(archives)))
        .option("member", member)
        .option("only_first", str(only_first).lower())
        .load()
    )


def zip_headerless(
    spark: SparkSession, archives: Sequence[str], names: Sequence[str], member: str = ""
) -> DataFrame:
    """Headerless members of all archives as one relation."""
    records = zip_records(spark, archives, member)
    parsed = parse_record(repair_record(F.col("record")), names)
    return records.select(parsed.alias("r")).select("r.*")


def zip_with_header(spark: SparkSession, archives: Sequence[str], member: str = "") -> DataFrame:
    """Members with a header line as one relation, plus ``_arquivo`` (archive and member name).

    The members must agree on the header.
    """
    records = zip_records(spark, archives, member)
    firsts = zip_records(spark, archives, member, only_first=True)
    parsed = parse_record(repair_record(F.col("record")), _one_header(firsts, member))
    return (
        records.filter("number > 0")
        .select(parsed.alias("r"), F.concat_ws("/", "archive", "member").alias("_arquivo"))
        .select("r.*", "_arquivo")
    )
