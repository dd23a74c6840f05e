"""Stage tables on shared storage.

Stages hand over written tables, never cached blocks: a lost executor costs a re-read, not a
recomputation of everything before it, and later plans start from a scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from contraluz.session import scratch_dir


# months as folder names, which a read without a schema would take for numbers
PERIODS = ("competencia", "mes_arquivo")
# Spark's folder name for a null or empty partition value
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def grouped_for(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Bring the rows of a storage partition together before a write.

    Otherwise every task writes a file into every partition. Rebalancing, unlike a plain
    repartition, also splits a storage partition that is much bigger than the others.
    """
    return df.hint("rebalance", *partition_by) if partition_by else df


@dataclass
class TableStore:
    """Parquet tables below one folder."""

    spark: SparkSession
    folder: str
    schemas: dict[str, T.StructType] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Replace the table and return it as read back."""
        writer = grouped_for(df, partition_by).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.option("partitionOverwriteMode", "static").parquet(self.path(name))
        self.schemas[name] = nullable(df.schema)
        return self.read(name)

    def _hadoop(self, path: str):
        """The file system of a path, as the session knows it, and the path."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def exists(self, name: str) -> bool:
        """Whether the table was written completely, in this session or another.

        A write of the whole table leaves a mark; one that replaces storage partitions only these.
        """
        system, path = self._hadoop(self.path(name))
        if not system.exists(path):
            return False
        names = (found.getPath().getName() for found in system.listStatus(path))
        return any(found == "_SUCCESS" or "=" in found for found in names)

    def replace_partitions(self, name: str, df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
        """Replace the storage partitions that ``df`` has rows of; all others stay.

        ``df`` must not read the table itself: hand in a written result.
        """
        (
            grouped_for(df, partition_by)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partition_by)
            .parquet(self.path(name))
        )
        self.schemas.setdefault(name, nullable(df.schema))
        return self.read(name)

    def drop_partitions(self, name: str, column: str, values: Sequence[str]) -> None:
        """Remove storage partitions (months as text; an empty value is the null partition)."""
        for value in values:
            if not re.fullmatch(r"\w*", value):
                raise ValueError(f"not a plain partition value: {value!r}")
            folder = f"{column}={value or NO_VALUE}"
            system, path = self._hadoop(f"{self.path(name)}/{folder}")
            system.delete(path, True)

    def read(self, name: str) -> DataFrame:
        """The table, also one that an earlier session wrote; partition columns are text."""
        schema = self.schemas.get(name)
        if schema is None:
            found = self.spark.read.parquet(self.path(name))
            schema = self.schemas[name] = T.StructType(
                [
                    T.StructField(f.name, T.StringType() if f.name in PERIODS else f.dataType)
                    for f in found.schema
                ]
            )
        return self.spark.read.schema(schema).parquet(self.path(name))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result that several branches of a plan read, and read it back.

    Column pruning makes the branches differ, so Spark would otherwise compute it once for each.
    """
    return TableStore(df.sparkSession, scratch_dir(df.sparkSession, "stage")).write(label, df)
