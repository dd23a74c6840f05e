"""Companies linked by a common partner.

High confidence: same name and same document. Medium: same name, document missing on at least one
side, and the name is not a hyperconnector (found in more than ``limit`` companies).

The pair table can be far bigger than the partner table, so only :func:`links` builds all of it, on
demand: what is stored are the groups (``holdings``), and :func:`count_links_grouped` counts from them.
Everything that asks about some companies uses :func:`links_from`, which expands their groups
only, and the per-company risk needs no pairs at all (``plans.risk.company_risk``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contraluz.functions import text
from contraluz.operators.hot_groups import CELL_ROWS, grid_join, pairs_within
from contraluz.tables import staged

HYPERCONNECTOR_LIMIT = 20


def holdings(partners: DataFrame) -> DataFrame:
    """Distinct (company, partner name, document digits)."""
    return (
        partners.filter(F.trim("nome_socio") != "")
        .select(
            "cnpj_basico",
            "nome_socio",
            text.document_digits(F.col("cpf_mascarado")).alias("doc"),
        )
        .distinct()
    )


def documented(held: DataFrame) -> DataFrame:
    return held.filter((F.col("doc") != "") & (F.col("doc") != "000000"))


def high_links(held: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs with equal name and document. Big groups are cut into cells, never dropped."""
    pairs = pairs_within(documented(held), ["nome_socio", "doc"], "cnpj_basico", cell_rows)
    return pairs.select(
        F.col("a").alias("cnpj_a"),
        F.col("b").alias("cnpj_b"),
        F.col("nome_socio").alias("socio_comum"),
        F.lit("alta").alias("confianca"),
    )


def _by_name(held: DataFrame) -> DataFrame:
    """One row per (name, company), telling whether the company has the name undocumented."""
    return held.groupBy("nome_socio", "cnpj_basico").agg(
        F.bool_or(F.col("doc") == "").alias("sem_doc")
    )


def hyperconnectors(held: DataFrame, limit: int = HYPERCONNECTOR_LIMIT) -> DataFrame:
    """Names found in more than ``limit`` companies, with the number of companies."""
    return (
        _by_name(held)
        .groupBy("nome_socio")
        .agg(F.count(F.lit(1)).alias("empresas"))
        .filter(F.col("empresas") > limit)
    )


def _name_groups(held: DataFrame, limit: int) -> DataFrame:
    """Names usable for medium links, with their companies as an array of at most ``limit``.

    ``limit + 1`` companies are enough to know that a name is a hyperconnector, which the rule
    drops whole. The group limit runs before the shuffle too, so such a name stays cheap however
    many companies carry it, and the names that remain are complete.
    """
    window = Window.partitionBy("nome_socio").orderBy("cnpj_basico")
    return (
        _by_name(held)
        .withColumn("_n", F.row_number().over(window))
        .filter(F.col("_n") <= limit + 1)
        .groupBy("nome_socio")
        .agg(F.collect_list(F.struct("cnpj_basico", "sem_doc")).alias("membros"))
        .filter(
            F.size("membros").between(2, limit)
            & F.exists("membros", lambda m: m["sem_doc"])
        )
    )


def _counterparts(wanted: Callable[[Column], Column]) -> Column:
    """Companies of the group linked to member ``m``: either side lacks the document."""
    linked = F.filter(
        "membros", lambda o: wanted(o) & (o["sem_doc"] | F.col("m.sem_doc"))
    )
    return F.transform(linked, lambda o: o["cnpj_basico"])


def medium_links(
    held: DataFrame, limit: int | None = HYPERCONNECTOR_LIMIT, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Pairs with equal name where at least one side has no document; distinct.

    Names of more than ``limit`` companies link nothing; with None every name links.
    """
    if limit is None:
        members = _by_name(held)
        bare = members.filter("sem_doc").select("nome_socio", F.col("cnpj_basico").alias("_sem"))
        every = members.select("nome_socio", F.col("cnpj_basico").alias("_outra"))
        pairs = grid_join(bare, every, ["nome_socio"], "_sem", "_outra", cell_rows)
        return pairs.filter("_sem <> _outra").select(
            F.least("_sem", "_outra").alias("cnpj_a"),
            F.greatest("_sem", "_outra").alias("cnpj_b"),
            F.col("nome_socio").alias("socio_comum"),
            F.lit("media").alias("confianca"),
        ).distinct()
    first = _name_groups(held, limit).select(
        "nome_socio", F.explode("membros").alias("m"), "membros"
    )
    return first.select(
        F.col("m.cnpj_basico").alias("cnpj_a"),
        F.explode(_counterparts(lambda o: o["cnpj_basico"] > F.col("m.cnpj_basico"))).alias(
            "cnpj_b"
        ),
        F.col("nome_socio").alias("socio_comum"),
        F.lit("media").alias("confianca"),
    )


def best_confidence() -> Column:
    """Aggregate: ``alta`` if any row is. A boolean buffer keeps the aggregation hash-based."""
    high = F.bool_or(F.col("confianca") == "alta")
    return F.when(high, F.lit("alta")).otherwise(F.lit("media")).alias("confianca")


def links(
    held: DataFrame, limit: int | None = HYPERCONNECTOR_LIMIT, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """All links, one row per (pair, partner); high confidence beats medium."""
    both = high_links(held, cell_rows).unionByName(medium_links(held, limit, cell_rows))
    return both.groupBy("cnpj_a", "cnpj_b", "socio_comum").agg(best_confidence())


def _tags(origins: DataFrame) -> list[str]:
    return [c for c in origins.columns if c != "cnpj_basico"]


def _touching(df: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows of the origins; with the tag columns of ``origins`` when it has any."""
    return df.join(origins, "cnpj_basico", "inner" if _tags(origins) else "left_semi")


def _groups_of(held: DataFrame, mine: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``held`` in a group of ``mine``, so that no other group is shuffled or ranked."""
    return held.join(mine.select(*keys).distinct(), keys, "left_semi")


def medium_links_seen(
    held: DataFrame, origins: DataFrame, limit: int | None, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Medium links with an end in ``origins``, as seen from that end."""
    own = held.join(origins.select("cnpj_basico").distinct(), "cnpj_basico", "left_semi")
    near = _groups_of(held, own, ["nome_socio"])
    if limit is None:
        members = _by_name(near)
        mine = _touching(members, origins).withColumnsRenamed(
            {"cnpj_basico": "origem", "sem_doc": "_sem"}
        )
        theirs = members.withColumnsRenamed({"cnpj_basico": "outra", "sem_doc": "_outra_sem"})
        both = grid_join(mine, theirs, ["nome_socio"], "origem", "outra", cell_rows)
        return both.filter("origem <> outra and (_sem or _outra_sem)").select(
            *_tags(origins), "origem", "outra", F.col("nome_socio").alias("socio_comum"),
            F.lit("media").alias("confianca"),
        )
    seen = _touching(
        _name_groups(near, limit)
        .select("nome_socio", F.explode("membros").alias("m"), "membros")
        .withColumn("cnpj_basico", F.col("m.cnpj_basico")),
        origins,
    )
    others = _counterparts(lambda o: o["cnpj_basico"] != F.col("m.cnpj_basico"))
    return seen.select(
        *_tags(origins),
        F.col("cnpj_basico").alias("origem"),
        F.explode(others).alias("outra"),
        F.col("nome_socio").alias("socio_comum"),
        F.lit("media").alias("confianca"),
    )


def links_from(
    held: DataFrame,
    origins: DataFrame,
    limit: int | None = HYPERCONNECTOR_LIMIT,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Links with an end in ``origins(cnpj_basico, tags...)``, as seen from that end.

    Columns: tags, origem, outra, socio_comum, confianca. ``origins`` is distinct; a link between
    two origins appears once from each.
    """
    return (
        links_seen(held, origins, limit, cell_rows)
        .groupBy(*_tags(origins), "origem", "outra", "socio_comum")
        .agg(best_confidence())
    )


def links_seen(
    held: DataFrame, origins: DataFrame, limit: int | None, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """As :func:`links_from` before the best confidence per link is chosen; rows may repeat."""
    names, tags = ["nome_socio", "doc"], _tags(origins)
    docs = documented(held)
    mine = _touching(docs, origins).select(*tags, *names, F.col("cnpj_basico").alias("origem"))
    theirs = _groups_of(docs, mine, names).select(*names, F.col("cnpj_basico").alias("outra"))
    high = (
        grid_join(mine, theirs, names, "origem", "outra", cell_rows)
        .filter(F.col("origem") != F.col("outra"))
        .select(
            *tags,
            "origem",
            "outra",
            F.col("nome_socio").alias("socio_comum"),
            F.lit("alta").alias("confianca"),
        )
    )
    return high.unionByName(medium_links_seen(held, origins, limit, cell_rows))


def _document_sets(held: DataFrame) -> DataFrame:
    """One row per (name, company): its usable documents, and whether it has the name undocumented."""
    usable = (F.col("doc") != "") & (F.col("doc") != "000000")
    return held.groupBy("nome_socio", "cnpj_basico").agg(
        F.sort_array(F.collect_set(F.when(usable, F.col("doc")))).alias("docs"),
        F.bool_or(F.col("doc") == "").alias("sem_doc"),
    )


def _whole_pairs(n: Column) -> Column:
    return F.shiftright(n * (n - 1), 1)


def _shared_twice(members: DataFrame) -> DataFrame:
    """``(nome_socio, todas, livres)``: how often pairs are counted too often, document by document.

    Only companies with several documents of one name can meet in more than one. Those with the same
    documents are one class with a size, so what is joined is classes.
    """
    several = members.filter(F.size("docs") > 1)
    classes = staged(
        several.groupBy("nome_socio", "docs", "sem_doc")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("classe", F.monotonically_increasing_id()),
        "classes",
    )
    excess = (F.size("docs") - 1) * _whole_pairs(F.col("n"))
    inside = classes.select(
        "nome_socio", excess.alias("todas"), F.when(F.col("sem_doc"), 0).otherwise(excess).alias("livres")
    )
    places = staged(classes.select("nome_socio", F.explode("docs").alias("doc"), "classe"), "lugares")
    met = pairs_within(places, ["nome_socio", "doc"], "classe").groupBy("a", "b").agg(
        (F.count(F.lit(1)) - 1).alias("k")
    )
    sides = [
        classes.select(F.col("classe").alias(c), F.col("n").alias(f"n{c}"), F.col("sem_doc").alias(f"s{c}"))
        for c in ("a", "b")
    ]
    across = F.col("k") * F.col("na") * F.col("nb")
    between = (
        met.filter("k > 0")
        .join(sides[0], "a")
        .join(sides[1], "b")
        .join(classes.select(F.col("classe").alias("a"), "nome_socio"), "a")
        .select(
            "nome_socio",
            across.alias("todas"),
            F.when(F.col("sa") | F.col("sb"), 0).otherwise(across).alias("livres"),
        )
    )
    return (
        inside.unionByName(between)
        .groupBy("nome_socio")
        .agg(F.sum("todas").alias("todas"), F.sum("livres").alias("livres"))
    )


def count_links_grouped(held: DataFrame, limit: int | None = HYPERCONNECTOR_LIMIT) -> DataFrame:
    """What :func:`count_links` says of :func:`links`, from group sizes: no pair is made.

    Of a name, n companies are n(n-1)/2 pairs. High links are counted document by document; pairs that
    share k documents were counted k - 1 times too often, which is taken off class by class. Medium
    links are the pairs with an undocumented side. Where both kinds count, high links are those among
    the companies that have the name documented only, as all others are medium links already.
    """
    members = staged(_document_sets(held), "documentos")
    sizes = members.groupBy("nome_socio").agg(
        F.count(F.lit(1)).alias("empresas"), F.count_if("sem_doc").alias("nuas")
    )
    by_doc = (
        members.select("nome_socio", F.explode("docs").alias("doc"), "sem_doc")
        .groupBy("nome_socio", "doc")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("sem_doc")).alias("m"))
        .groupBy("nome_socio")
        .agg(
            F.sum(_whole_pairs(F.col("n"))).alias("pares"),
            F.sum(_whole_pairs(F.col("m"))).alias("pares_livres"),
        )
    )
    rows = sizes.join(by_doc, "nome_socio", "left").join(_shared_twice(members), "nome_socio", "left")
    none = F.lit(0).cast("long")
    high = F.coalesce("pares", none) - F.coalesce("todas", none)
    free = F.coalesce("pares_livres", none) - F.coalesce("livres", none)
    medium = _whole_pairs(F.col("empresas")) - _whole_pairs(F.col("empresas") - F.col("nuas"))
    hyper = F.lit(False) if limit is None else F.col("empresas") > limit
    return rows.agg(
        F.coalesce(F.sum(F.when(hyper, high).otherwise(free + medium)), none).alias("vinculos"),
        F.coalesce(F.sum(high), none).alias("vinculos_alta"),
    )


def count_links(all_links: DataFrame) -> DataFrame:
    """Load metrics: links, and those of high confidence."""
    return all_links.agg(
        F.count(F.lit(1)).alias("vinculos"),
        F.count_if(F.col("confianca") == "alta").alias("vinculos_alta"),
    )
