"""Merkle manifest of a dataset, with a proof for each row.

An aligned block of leaves keeps each level of its tree as one string of hex digests. Parents are hashes of substrings
of fixed width, the siblings of a node are the substrings that flank it, and the roots of the blocks are the leaves of
the next round, until each group has one root; the roots of the groups go through the same rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.ranks import ranked
from shelfwise.llm.storage import stored

FAN = 3
#: Levels that a block goes up in one round; a block holds FAN ** LEVELS nodes.
LEVELS = 6
DIGEST = 64
SIDE = "struct<left: string, right: string>"


def field(value: Column) -> Column:
    """A value as hashed: its count of UTF-8 bytes, a colon, the value; `-` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*[field(value) for value in values]), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, digest, lambda acc, side: F.sha2(F.concat(side["left"], acc, side["right"]), 256))


def siblings(path: Column) -> Column:
    """The digests of all siblings in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), "")


def _height(n: Column) -> Column:
    """Levels above `n` leaves: the least h with FAN ** h >= n."""
    return F.size(F.filter(F.lit([FAN**j for j in range(39)]), lambda power: power < n))


def _parents(level: Column) -> Column:
    run = FAN * DIGEST
    last = F.floor((F.octet_length(level) - 1) / F.lit(run)).cast("int")
    return F.array_join(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), ""
    ).cast("binary")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (tree, place, n, digest, row) as blocks (tree, block, n, members, levels, root)."""
    width = FAN**levels
    gathered = nodes.groupBy("tree", F.floor(F.col("place") / F.lit(width)).alias("block")).agg(
        F.first("n").alias("n"),
        F.array_sort(
            F.collect_list(F.struct("place", "digest", "row")),
            lambda a, b: F.when(a["place"] < b["place"], -1).otherwise(1),
        ).alias("members"),
    )
    bottom = F.array_join(F.transform("members", lambda member: member["digest"]), "").cast("binary")
    climbs = F.least(_height(F.col("n")), F.lit(levels))
    up = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda j: j < climbs),
        F.array(bottom),
        lambda strings, _: F.concat(strings, F.transform(F.slice(strings, -1, 1), _parents)),
    )
    return stored(gathered.withColumn("levels", up), "blocks").withColumn(
        "root", F.element_at("levels", -1).cast("string")
    )


def _climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and (tree, digest) of the roots."""
    rounds = []
    while True:
        rounds.append(_blocks(nodes, levels))
        width = FAN**levels
        nodes = rounds[-1].select(
            "tree",
            F.col("block").alias("place"),
            F.floor((F.col("n") + (width - 1)) / F.lit(width)).alias("n"),
            F.col("root").alias("digest"),
            F.lit(None).cast("int").alias("row"),
        )
        if nodes.where(F.col("n") > 1).isEmpty():
            return rounds, nodes.select("tree", "digest")


def _sides(levels: Column, j: Column) -> Column:
    """What stands left and right of node `j` of a block on each level below the top."""

    def at(height: Column, level: Column) -> Column:
        node = F.floor(j / F.pow(F.lit(float(FAN)), height)).cast("int")
        first = node - F.pmod(node, F.lit(FAN))
        left = F.substring(level, first * DIGEST + 1, (node - first) * DIGEST)
        right = F.substring(level, (node + 1) * DIGEST + 1, (first + FAN - 1 - node) * DIGEST)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), lambda level, height: at(height, level))


def _descend(rounds: list[DataFrame], tops: DataFrame, *passed: str) -> DataFrame:
    """(tree, row, digest, path, *passed) of the lowest nodes, from tops (tree, path, *passed)."""
    above = tops.withColumn("place", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        members = F.transform(
            "members",
            lambda member, j: F.struct(
                member["place"].alias("place"),
                member["row"].alias("row"),
                member["digest"].alias("digest"),
                _sides(F.col("levels"), j).alias("sides"),
            ),
        )
        opened = blocks.drop("n", "root").join(above.withColumnRenamed("place", "block"), ["tree", "block"]).select(
            "tree", "path", *passed, F.explode(members).alias("member")
        )
        above = opened.select(
            "tree",
            "member.place",
            "member.row",
            "member.digest",
            F.concat("member.sides", "path").alias("path"),
            *passed,
        )
    return above.drop("place")


def manifest(
    docs: DataFrame, digest: Column, group: Column, key: Column, kept: list[Column], levels: int = LEVELS
) -> DataFrame:
    """(row, leaf, path, subroot, root) for each row of `docs`; `row` holds the `kept` columns.

    `digest` is a row's leaf. The leaves of a group ascend by `key` (null first, equal ones by digest); the groups
    ascend bytewise, null first. Repeated rows are a leaf each. A lone leaf is its group's root, a lone group's root
    that of the dataset; no rows give none. `path` has a struct of the digests to the left and to the right for each
    level up to the root. Columns of `docs` that aren't named take no part, whatever they are called; long texts cost
    one hash and go no further than the first scan.
    """
    leaves = stored(
        docs.select(
            field(group).alias("tree"),
            group.cast("string").alias("name"),
            key.alias("key"),
            digest.alias("digest"),
            F.struct(*kept).alias("row"),
        ),
        "leaves",
    )
    rounds, subroots = _climb(ranked(leaves.drop("name"), ["tree"], ["key", "digest"]), levels)
    groups = leaves.select("tree", "name").distinct().join(subroots, "tree")
    groups = ranked(groups.withColumn("all", F.lit(0)), ["all"], ["name"])
    names, root = _climb(
        groups.select(
            F.col("all").cast("string").alias("tree"), "place", "n", "digest", F.struct("tree").alias("row")
        ),
        levels,
    )
    top = root.select("tree", F.array().cast(f"array<{SIDE}>").alias("path"), F.col("digest").alias("root"))
    tops = _descend(names, top, "root").select("row.tree", "path", "root", F.col("digest").alias("subroot"))
    return _descend(rounds, tops, "subroot", "root").select(
        "row", F.col("digest").alias("leaf"), "path", "subroot", "root"
    )
