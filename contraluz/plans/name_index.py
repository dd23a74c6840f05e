"""Search by part of a name from an inverted index instead of a scan.

Every run of three characters of a normalised name is a gram; the index holds (gram, company), sorted
by gram, so that the postings of a gram are a few row groups. A pattern's literal parts say which grams
a match must have. The rarest of these is looked up first and the next ones cut it down; what is left
is checked against the pattern itself, as grams alone say nothing about order. Patterns without three
letters in a row have no gram and are answered by a scan of the stored, already normalised names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contraluz.functions import text
from contraluz.plans.companies import like, listed, typed_root
from contraluz.tables import TableStore

GRAM = 3
LOOKED_UP = 3  # rarest grams of a pattern whose postings are read
NAMES, POSTINGS, COUNTS = "nomes_busca", "nomes_trigramas", "nomes_trigramas_contagem"


def grams(name: Column) -> Column:
    """Distinct runs of three characters; shorter names have none."""
    starts = F.sequence(F.lit(1), F.length(name) - (GRAM - 1))
    runs = F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, F.lit(GRAM))))
    return F.when(F.length(name) >= GRAM, runs).otherwise(F.array().cast("array<string>"))


def pattern_grams(pattern: str) -> list[str]:
    """Grams that every match of a pattern has: those of its parts between wildcards."""
    parts = re.split("[%_]", pattern)
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


@dataclass(frozen=True)
class NameIndex:
    """The stored names, postings and gram counts of a table store."""

    store: TableStore

    @classmethod
    def build(cls, store: TableStore, all_names: DataFrame) -> NameIndex:
        """Write the index of all known names (``companies.names``).

        A gram that very many names have is split over range partitions by company.
        """
        named = all_names.select(
            "cnpj_basico", "nome", "prioridade", text.normalize_name(F.col("nome")).alias("normalizado")
        ).distinct()
        names = store.write(NAMES, _sorted(named, "cnpj_basico", "prioridade", "nome"))
        pairs = names.select(F.explode(grams(F.col("normalizado"))).alias("trigrama"), "cnpj_basico")
        postings = store.write(POSTINGS, _sorted(pairs.distinct(), "trigrama", "cnpj_basico"))
        counts = postings.groupBy("trigrama").agg(F.count(F.lit(1)).alias("empresas"))
        store.write(COUNTS, _sorted(counts, "trigrama"))
        return cls(store)

    def candidates(self, pattern: str) -> DataFrame | None:
        """Companies with the pattern's rarest grams; None if it has no gram."""
        wanted = pattern_grams(pattern)
        if not wanted:
            return None
        # one row for each gram of the pattern at most
        rows = self.store.read(COUNTS).filter(F.col("trigrama").isin(wanted)).collect()
        known = {row["trigrama"]: row["empresas"] for row in rows}
        if len(known) < len(wanted):
            return self.store.read(POSTINGS).filter(F.lit(False)).select("cnpj_basico")
        rarest = sorted(wanted, key=lambda g: (known[g], g))[:LOOKED_UP]
        found = None
        for gram in rarest:
            held = self.store.read(POSTINGS).filter(F.col("trigrama") == gram).select("cnpj_basico")
            found = held if found is None else found.join(held, "cnpj_basico", "left_semi")
        return found

    def matching(self, query: str) -> DataFrame:
        """Names that a typed query matches: by root, or by part of the name."""
        names, root = self.store.read(NAMES), typed_root(query)
        if root is not None:
            found = names.filter(F.col("cnpj_basico") == root)
        else:
            spark = self.store.spark
            pattern = spark.range(1).select(text.normalize_name(F.lit(query))).first()[0]
            companies = self.candidates(pattern)
            if companies is not None:
                names = names.join(companies, "cnpj_basico", "left_semi")
            found = names.filter(like(F.col("normalizado"), F.lit(f"%{pattern}%")))
        return found.select("cnpj_basico", "nome", "prioridade")

    def search(
        self,
        query: str,
        establishments: DataFrame,
        risk_per_company: DataFrame,
        limit: int | None = None,
    ) -> DataFrame:
        """What ``companies.search`` gives for the same query over the same names."""
        return listed(self.matching(query), establishments, risk_per_company, limit)


def _sorted(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in ranges of the columns, so that a lookup by the first one skips most row groups."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)
