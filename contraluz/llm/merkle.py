"""Merkle manifest of a dataset, with a proof for every row (operator 12).

Rows of a tree are ranked, and the digits of the rank are columns. Within a bounded block of
``fan ** digits`` rows the digit columns are grouped away one after another, the last first: each
group's nodes become the children of one node, nested as structs, with the digest of their digests.
All groupings of a round use one shuffle by block. The blocks are the leaves of the next round, until
a tree has one node. Then the way down: a ``transform`` gives every child its siblings and an
``explode`` makes the children rows, level by level, so that inside a block proofs come out without a
join. Only between rounds does a block meet its own upper path, one row each, a ``fan ** digits``-th
of the rows below. The roots of the trees are, in their order, the leaves of one more tree.

A block's row is bounded by its leaves; ranks come from range partitions, so that neither a tree with
a third of all rows nor one tree in all goes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contraluz.llm.common import checkpointed, shuffle_partitions

FAN = 8
DIGITS = 3
_STEPS = "array<struct<before:string,after:string>>"


def digest_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return digest_of(*[encoded(f) for f in fields])


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda low, s: digest_of(s["before"], low, s["after"]))


def siblings(steps: Column) -> Column:
    """All digests of a proof, level by level, left to right, in one string."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def _ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``at``, their place in their ``tree``, and ``n``, its size.

    What is joined to the rows is one row for each tree of each range partition.
    """
    parts = shuffle_partitions(leaves.sparkSession)
    keys = ["tree", *order]
    ranged = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part).withColumn("_within", within).drop("_at")
    runs = placed.groupBy("tree", "_part").agg(F.min("_within").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "tree",
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(tree).alias("n"),
    )
    return (
        placed.join(starts, ["tree", "_part"])
        .withColumn("at", F.col("_within") + F.col("_shift"))
        .drop("_part", "_within", "_shift")
    )


def _height(n: Column, fan: int) -> Column:
    """How many times ``n`` nodes are grouped until one is left."""
    powers, power = [], 1
    while power < 1 << 62:
        powers.append(F.when(n > F.lit(power), 1).otherwise(0))
        power *= fan
    return sum(powers[1:], powers[0])


def _rolled(nodes: DataFrame, fan: int, digits: int) -> DataFrame:
    """``(tree, at, height, digest, kids)``: one row a block, its nodes nested below it.

    ``nodes`` are ``(tree, at, height, digest, own)``. Levels beyond the height of a tree have one
    node, which passes through with its digest.
    """
    place = [F.pmod(F.expr(f"at div {fan**d}"), F.lit(fan)).cast("int").alias(f"d{d}") for d in range(digits)]
    spread = nodes.select(
        "tree",
        "height",
        F.expr(f"at div {fan**digits}").alias("block"),
        *place,
        F.struct(place[0].alias("at"), "digest", F.col("own").alias("kids")).alias("node"),
    )
    rows = spread.repartition(shuffle_partitions(nodes.sparkSession), "tree", "block")
    for level in range(digits):
        left = [f"d{d}" for d in range(level + 1, digits)]
        kids = F.sort_array(F.collect_list("node")).alias("kids")
        up = rows.groupBy("tree", "height", "block", *left).agg(kids)
        joined = F.array_join(F.col("kids.digest"), "")
        digest = F.when(F.col("height") > level, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["digest"])
        up = up.withColumn("digest", digest)
        if not left:
            return up.select("tree", F.col("block").alias("at"), "height", "digest", "kids")
        node = F.struct(F.col(left[0]).alias("at"), "digest", "kids").alias("node")
        rows = up.select("tree", "height", "block", *left, node)
    raise ValueError("a block needs a digit")


def _rounds(leaves: DataFrame, fan: int, digits: int) -> list[DataFrame]:
    """Written tables of blocks, from the leaves up; in the last one every tree has one row."""
    nodes = checkpointed(leaves.withColumn("height", _height(F.col("n"), fan)).drop("n"))
    left = nodes.agg(F.max("height").alias("h")).first()["h"] or 0
    rounds = []
    while True:
        rounds.append(checkpointed(_rolled(nodes, fan, digits)))
        left -= digits
        if left <= 0:
            return rounds
        nodes = rounds[-1].select(
            "tree",
            "at",
            F.greatest(F.col("height") - digits, F.lit(0)).alias("height"),
            "digest",
            F.lit(None).cast("int").alias("own"),
        )


def _proofs(rounds: list[DataFrame], tops: DataFrame, fan: int, digits: int) -> DataFrame:
    """``(tree, at, top, steps, digest, own)`` of every leaf.

    ``tops`` are ``(tree, top, steps)``: what each tree's only last node hands down.
    """
    paths = tops.withColumn("at", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        rows = blocks.join(paths, ["tree", "at"]).select("tree", "at", "height", "top", "steps", "kids")
        for level in reversed(range(digits)):

            def child(kid: Column, i: Column) -> Column:
                digests = F.col("kids.digest")
                before = F.array_join(F.slice(digests, F.lit(1), i), "")
                after = F.array_join(F.slice(digests, i + 2, F.lit(fan)), "")
                step = F.struct(before.alias("before"), after.alias("after"))
                return F.struct(kid["at"].alias("at"), kid["digest"].alias("digest"), kid["kids"].alias("kids"), step.alias("step"))

            deeper = F.concat(F.array("kid.step"), F.col("steps"))
            rows = rows.select("tree", "at", "height", "top", "steps", F.explode(F.transform("kids", child)).alias("kid"))
            rows = rows.select(
                "tree",
                (F.col("at") * fan + F.col("kid.at")).alias("at"),
                "height",
                "top",
                F.when(F.col("height") > level, deeper).otherwise(F.col("steps")).alias("steps"),
                F.col("kid.digest").alias("digest"),
                F.col("kid.kids").alias("kids"),
            )
        paths = rows.select("tree", "at", "top", "steps", "digest", F.col("kids").alias("own"))
    return paths


def manifest(
    docs: DataFrame,
    fields: list[str],
    tree: str,
    order: str,
    carry: dict[str, Column] | None = None,
    fan: int = FAN,
    digits: int = DIGITS,
) -> DataFrame:
    """``(tree, place, leaf, subroot, root, steps)`` and the carried columns, for every row of ``docs``.

    A leaf is the digest of the encoded ``fields``. The leaves of a value of the column ``tree``, in
    the order of ``order``, form a tree of ``fan``; the subroots, by value (null first, then by
    UTF-8 bytes), form the last one. ``steps`` are the digests before and after a node in its run of
    siblings, from the leaf to the root. ``carry`` names expressions over ``docs`` that come back with
    the row (orderable types, as blocks are sorted).

    Null fields have a code of their own, so null and empty differ. Rows equal in ``order`` ascend by
    leaf, nulls first; repeated rows are leaves of their own. A tree of one row has its leaf as
    subroot. An empty table gives no rows. Only the columns named are read, so others may have any
    name. A very long text is hashed where it stands; only digests travel.
    """
    # a prefix keeps null apart from every value, and below all of them
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree")
    own = F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in (carry or {}).items()]).alias("own")
    digest = leaf_digest(*[F.col(f) for f in fields]).alias("digest")
    leaves = docs.select(key, F.col(order).alias("_order"), digest, own)
    ranked = _ranked(leaves, ["_order", "digest"]).select("tree", "at", "n", "digest", "own")
    rounds = _rounds(ranked, fan, digits)

    subroots = rounds[-1].select(F.col("tree").alias("_tree"), "digest")
    trees = subroots.select(F.lit("").alias("tree"), "digest", F.struct("_tree").alias("own"), F.col("_tree").alias("_order"))
    upper = _rounds(_ranked(trees, ["_order"]).select("tree", "at", "n", "digest", "own"), fan, digits)
    none = F.array().cast(_STEPS).alias("steps")
    tops = upper[-1].select("tree", F.col("digest").alias("top"), none)
    above = _proofs(upper, tops, fan, digits).select(
        F.col("own._tree").alias("tree"),
        F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top"),
        "steps",
    )
    found = _proofs(rounds, above, fan, digits)
    return found.select(
        F.expr("if(tree = '', null, substring(tree, 2))").alias("tree"),
        F.col("at").alias("place"),
        F.col("digest").alias("leaf"),
        "top.subroot",
        "top.root",
        "steps",
        *[F.col(f"own.{k}").alias(k) for k in carry or {}],
    )
