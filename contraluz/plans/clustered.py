"""Tables laid out by company root, for lookups of single companies and joins by root.

Every table has the root as a column of its own, ``raiz``. It is bucketed on it and sorted inside the
buckets: a filter on roots reads the row groups of their buckets only, and tables with as many buckets
meet without an exchange. A bucket is read by one task, so choose ``buckets`` by the size of the biggest
table; sums over a company with very many rows stream through its task in constant memory.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contraluz.functions import text
from contraluz.plans.contracts import running
from contraluz.tables import TableStore

BUCKETS = 256


@dataclass(frozen=True)
class Clustered:
    """Bucketed tables below a store's folder, registered in the session's catalog."""

    store: TableStore
    buckets: int = BUCKETS

    def _name(self, name: str) -> str:
        # one catalog holds the tables of several stores
        mark = self.store.spark.range(1).select(F.hex(F.crc32(F.lit(self.store.folder)))).first()[0]
        return f"{name}_por_raiz_{mark.lower()}"

    def write(self, name: str, df: DataFrame, root: Column) -> DataFrame:
        """Replace the table; rows whose root is null (persons) are left out."""
        (
            df.withColumn("raiz", root)
            .filter(F.col("raiz").isNotNull())
            .repartition(self.buckets, "raiz")
            .write.mode("overwrite")
            .bucketBy(self.buckets, "raiz")
            .sortBy("raiz")
            .option("path", self.store.path(f"{name}_por_raiz"))
            .saveAsTable(self._name(name))
        )
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """The table, also one that an earlier session wrote."""
        spark, known = self.store.spark, self._name(name)
        if not spark.catalog.tableExists(known):
            path = self.store.path(f"{name}_por_raiz")
            columns = ", ".join(
                f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema
            )
            spark.sql(
                f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY (raiz) SORTED BY (raiz) "
                f"INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )
        return spark.read.table(known)

    def build(
        self, sanctions: DataFrame, contracts: DataFrame, partners: DataFrame, risk: DataFrame
    ) -> Clustered:
        """Write the tables of a company sheet, and every root that is in one of them."""
        tables = {
            "sancoes": self.write("sancoes", sanctions, text.company_root(F.col("cnpj_cpf"))),
            "contratos": self.write("contratos", contracts, text.company_root(F.col("cnpj_contratado"))),
            "socios": self.write("socios", partners, F.col("cnpj_basico")),
            "risco": self.write("risco", risk, F.col("cnpj_basico")),
        }
        roots = None
        for table in tables.values():
            own = table.select("raiz").distinct()
            roots = own if roots is None else roots.union(own)
        self.write("raizes", roots.distinct(), F.col("raiz"))
        return self

    def sheet(self, as_of: date, roots: Sequence[str] | None = None) -> DataFrame:
        """Degree, sanctions, contracts and partners of every company, or of the given roots.

        The numbers of ``companies.audit_sheet``, summed bucket by bucket.
        """
        none = F.lit(0)

        def table(name: str) -> DataFrame:
            rows = self.read(name)
            return rows if roots is None else rows.filter(F.col("raiz").isin(list(roots)))

        sums = [
            table("risco").groupBy("raiz").agg(F.min("grau").alias("grau")),
            table("sancoes").groupBy("raiz").agg(
                F.count(F.lit(1)).alias("sancoes"), F.count_if("vigente").alias("sancoes_vigentes")
            ),
            table("contratos").groupBy("raiz").agg(
                F.count(F.lit(1)).alias("contratos"),
                F.count_if(running(as_of)).alias("contratos_vigentes"),
                F.sum("valor_final").alias("valor"),
            ),
            table("socios").groupBy("raiz").agg(F.count(F.lit(1)).alias("socios")),
        ]
        sheet = table("raizes")
        for part in sums:
            # both sides are bucketed alike, so a merge join needs no exchange
            sheet = sheet.join(part.hint("merge"), "raiz", "left")
        counts = ["sancoes", "sancoes_vigentes", "contratos", "contratos_vigentes", "socios"]
        return sheet.select(
            F.col("raiz").alias("cnpj_basico"),
            "grau",
            *[F.coalesce(c, none.cast("long")).alias(c) for c in counts],
            F.coalesce("valor", none).cast("decimal(38,2)").alias("valor_contratos"),
        )
