"""A trie of the prefixes that conversations share.

Each distinct turn has an id, each conversation is a sequence of ids, and equal sequences count as one with a weight.
Containers hold the rest of a sequence below a head, the node they hang from. A container with too many sequences bursts:
its head becomes a node, and each next id the head of a container of its own. Containers that remain are sorted, one
shard of them to a task, and swept into nodes; what a node says of its subtree is summed up head by head.

Conversations of more than `span` turns are cut at multiples of it. The digest of all that comes before a cut is the
head of what follows, so that no row holds a whole conversation of any length. Parts that only one conversation has
need no sums from below; shared parts are taken deepest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.ranks import ranked
from shelfwise.llm.storage import stored

NOTHING = hashlib.sha256(b"").hexdigest()
#: Ids of equal conversations that one row holds while they are digested.
CHUNK = 4096
ROWS = 10_000
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string"
)
TOP = "head string, up string, inner boolean"


@dataclass(frozen=True)
class Burst:
    """`limit`: sequences in a container that needn't burst. `span`: turns of a conversation in one row."""

    limit: int = 1000
    span: int = 256


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, n, id, bytes): each turn with its place in its conversation, from 0, the turns of the
    conversation, the id of its (role, text), and the UTF-8 bytes of its text.

    Turns are in the order of `turn`, null first; those that share a turn number are in the order of their ids. A null
    role or text is an empty one. Rows without `conv_id` belong to no conversation and are left out. Texts are hashed in
    the first scan and go no further, whatever their length; other columns aren't read. One conversation may hold any
    share of the rows.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.substring(F.sha2(said, 256), 1, 32).alias("id"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return ranked(turns, ["conv_id"], ["turn", "id"]).drop("turn")


def mixed(turns: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, place, total, id, bytes): conversation c with its first h turns replaced by those of c - c % group,
    where h is crc32(c) % (most + 1). A conversation that has no turn then has one row with a null place."""
    conv = F.col("conv_id")
    sizes = stored(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "sizes")
    bases = sizes.select(conv.alias("base"), F.col("own").alias("base_own"))
    plans = (
        sizes.withColumns({"base": conv - conv % group, "h": F.crc32(conv.cast("string")) % (most + 1)})
        .join(bases, "base", "left")
        .withColumn("used", F.least("h", F.coalesce("base_own", F.lit(0))))
        .withColumn("total", F.col("used") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .select("conv_id", "base", "h", "used", "total")
    )
    plans = stored(plans, "plans")
    own = turns.join(plans, "conv_id").where("place >= h").withColumn("place", F.col("used") + F.col("place") - F.col("h"))
    heads = turns.where(F.col("place") < most).select(conv.alias("base"), "place", "id", "bytes")
    borrowed = heads.join(plans.where("used > 0"), "base").where("place < used")
    none = plans.where("total = 0").withColumns(
        {"place": F.lit(None).cast("long"), "id": F.lit(None).cast("string"), "bytes": F.lit(None).cast("long")}
    )
    columns = ["conv_id", "place", "total", "id", "bytes"]
    return own.select(columns).unionByName(borrowed.select(columns)).unionByName(none.select(columns))


def _following(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (conv_id, s, own) in order: (conv_id, s, head), the digest of all parts before each part."""
    last, head = None, ""
    for batch in batches:
        heads = []
        for conv, own in zip(batch.column("conv_id").to_pylist(), batch.column("own").to_pylist(), strict=True):
            if conv != last:
                last, head = conv, ""
            heads.append(head)
            head = hashlib.sha256((head + own).encode()).hexdigest()
        yield pa.record_batch([batch.column("conv_id"), batch.column("s"), pa.array(heads, pa.string())], ["conv_id", "s", "head"])


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (node, chunk, ids) in order: (node, ends), the SHA-256 of all ids, comma-joined."""
    last, digest, done = None, None, []

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([d[i] for d in done], pa.string()) for i in range(2)], ["node", "ends"])

    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == last:
                digest.update(b",")
            else:
                if digest:
                    done.append((last, digest.hexdigest()))
                last, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        if len(done) >= ROWS:
            yield out()
            done = []
    if digest:
        done.append((last, digest.hexdigest()))
    yield out()


def _key(*parts: str) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _sequences(turns: DataFrame, span: int) -> DataFrame:
    """Parts of conversations as they differ: (s, head, own, next, ids, sizes, weight, least, on, ends).

    Part `s` begins after `s` times `span` turns; `head` is the digest of all that comes before it and `next` the head
    of what follows, `on` how many conversations go on there, `ends` the digest of the ids of those that end.
    """
    parts = (
        turns.groupBy("conv_id", F.coalesce(F.floor(F.col("place") / F.lit(span)), F.lit(0)).alias("s"))
        .agg(
            F.max("total").alias("total"),
            F.array_sort(
                F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "id", "bytes")))
            ).alias("turns"),
        )
        .select(
            "conv_id",
            "s",
            "total",
            F.col("turns.id").alias("ids"),
            F.col("turns.bytes").alias("sizes"),
            F.sha2(F.array_join("turns.id", ""), 256).alias("own"),
            (F.col("s") == F.floor((F.greatest(F.col("total"), F.lit(1)) - 1) / F.lit(span))).alias("last"),
        )
    )
    parts = stored(parts, "parts")
    long = parts.where(F.col("total") > span)
    if long.isEmpty():
        parts = parts.withColumn("head", F.lit(""))
    else:
        lined = long.select("conv_id", "s", "own").repartition("conv_id").sortWithinPartitions("conv_id", "s")
        heads = lined.mapInArrow(_following, "conv_id long, s long, head string")
        parts = parts.join(heads, ["conv_id", "s"], "left").withColumn("head", F.coalesce("head", F.lit("")))
    parts = stored(parts.withColumn("next", _key("head", "own")), "parts")
    ending = ranked(parts.where("last").select(F.col("next").alias("node"), F.col("conv_id").alias("conv")), ["node"], ["conv"])
    chunks = ending.groupBy("node", F.floor(F.col("place") / F.lit(CHUNK)).alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )
    ends = chunks.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(_ends, "node string, ends string")
    alike = parts.groupBy("s", "head", "own", "next").agg(
        F.first("ids").alias("ids"),
        F.first("sizes").alias("sizes"),
        F.count("*").alias("weight"),
        F.min("conv_id").alias("least"),
        F.sum(F.when(F.col("last"), 0).otherwise(1)).alias("on"),
    )
    joined = alike.join(ends.withColumnRenamed("node", "next"), "next", "left")
    return stored(joined.withColumn("ends", F.coalesce("ends", F.lit(NOTHING))), "sequences")


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers of a shard, whose rows come sorted by (head, ids)."""
    out: list[tuple] = []

    def swept(rows: list[dict]) -> None:
        first = rows[0]
        # a node: depth below the head, parent's place in the list, weight, least, children, leaves, saved, bytes, ends
        nodes = [[0, -1, 0, None, 0, 0, 0, first["last_bytes"], NOTHING]]
        path, before = [0], []
        for row in rows:
            ids = row["ids"][row["at"] :]
            sizes = row["sizes"][row["at"] :]
            same = 0
            while same < min(len(ids), len(before)) and ids[same] == before[same]:
                same += 1
            del path[same + 1 :]
            for i in range(same, len(ids)):
                nodes[path[-1]][4] += 1
                path.append(len(nodes))
                nodes.append([i + 1, path[-2], 0, None, 0, 0, 0, sizes[i], NOTHING])
            end = nodes[path[-1]]
            end[2] += row["weight"]
            end[3] = row["least"] if end[3] is None else min(end[3], row["least"])
            end[8] = row["ends"]
            if row["on"]:
                end[4] += row["below_children"]
                end[5] += row["below_leaves"]
                end[6] += row["below_saved"]
            before = ids
        # parents stand before their children
        for node in reversed(nodes):
            if node[4] == 0:
                node[5] = 1
            node[6] += (node[2] - 1) * node[7]
            if node[1] >= 0:
                above = nodes[node[1]]
                above[2] += node[2]
                above[3] = node[3] if above[3] is None else min(above[3], node[3])
                above[5] += node[5]
                above[6] += node[6]
        # the node before a cut also has the conversations that end there
        cut = first["up"] is None and first["depth"] > 0
        for node in nodes:
            above = first["above"] if node[1] < 0 or cut and node[1] == 0 else nodes[node[1]][3]
            top = (first["head"], first["up"], True) if node[1] < 0 else (None, None, False)
            out.append((node[3], first["depth"] + node[0], above, node[2], node[4], node[5], node[6], node[8], *top))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 3 + [pa.bool_()]
        names = [part.split()[0] for part in f"{NODE}, {TOP}".split(", ")]
        return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    container: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if container and row["head"] != container[0]["head"]:
                swept(container)
                container = []
            container.append(row)
            if len(out) >= ROWS:
                yield batch_of(out)
                out.clear()
    if container:
        swept(container)
    if out:
        yield batch_of(out)


def _grow(rows: DataFrame, limit: int) -> DataFrame:
    """(NODE, TOP) of all containers of `rows`, burst where they hold more than `limit` sequences. The heads of
    containers have their `head` and the head they burst from, `up`; the others have neither."""
    columns = rows.columns
    settled, bursts = [], []
    while True:
        counts = rows.groupBy("head").agg(
            F.count("*").alias("sequences"), F.sum("weight").alias("n_convs"), F.min("least").alias("conv_id")
        )
        large = stored(counts.where(F.col("sequences") > limit).drop("sequences"), "large")
        if large.isEmpty():
            settled.append(rows)
            break
        settled.append(rows.join(large.select("head"), "head", "left_anti"))
        opened = stored(
            rows.join(large, "head").withColumn("turn", F.get("ids", F.col("at").cast("int"))), "opened"
        )
        # each next turn first, so that what comes together for a head is a row for each of its children
        turns = opened.groupBy("head", "turn").agg(
            *[F.first(c).alias(c) for c in ("up", "depth", "above", "last_bytes", "n_convs", "conv_id")],
            F.max(F.when(F.col("turn").isNull(), F.struct("ends", "on", "below_children", "below_leaves", "below_saved"))).alias("end"),
        )
        heads = turns.groupBy("head").agg(
            *[F.first(c).alias(c) for c in ("up", "depth", "above", "last_bytes", "n_convs", "conv_id")],
            F.count("turn").alias("children"),
            F.max("end").alias("end"),
        )
        bursts.append(stored(heads, "heads"))
        rows = stored(
            opened.where("turn is not null").select(
                _key("head", "turn").alias("head"),
                F.col("head").alias("up"),
                (F.col("depth") + 1).alias("depth"),
                F.when(F.expr("up is null and depth > 0"), F.col("above")).otherwise(F.col("conv_id")).alias("above"),
                F.get("sizes", F.col("at").cast("int")).alias("last_bytes"),
                (F.col("at") + 1).alias("at"),
                *[c for c in columns if c not in ("head", "up", "depth", "above", "last_bytes", "at")],
            ),
            "rows",
        )
    remaining = reduce(DataFrame.unionByName, settled).select(
        "head", "up", "depth", "above", "last_bytes", "at", "ids", "sizes", "weight", "least", "on", "ends",
        "below_children", "below_leaves", "below_saved",
    )
    shards = remaining.repartition("head").sortWithinPartitions("head", "ids")
    nodes = stored(shards.mapInArrow(_sweep, f"{NODE}, {TOP}"), "nodes")
    done = [nodes]
    tops = nodes.where("inner").select("up", "n_leaves", "saved_tokens")
    for heads in reversed(bursts):
        below = tops.where("up is not null").groupBy(F.col("up").alias("head")).agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")
        )
        goes_on = F.coalesce(F.col("end.on") > 0, F.lit(False))
        further = {c: F.when(goes_on, F.col(f"end.below_{c}")).otherwise(0) for c in ("children", "leaves", "saved")}
        whole = heads.join(below, "head").select(
            "conv_id",
            "depth",
            F.col("above").alias("parent_conv_id"),
            "n_convs",
            (F.col("children") + further["children"]).alias("n_children"),
            (F.col("n_leaves") + further["leaves"]).alias("n_leaves"),
            (F.col("saved") + further["saved"] + (F.col("n_convs") - 1) * F.col("last_bytes")).alias("saved_tokens"),
            F.coalesce("end.ends", F.lit(NOTHING)).alias("ends_sha256"),
            "head",
            "up",
            F.lit(True).alias("inner"),
        )
        done.append(stored(whole, "nodes"))
        tops = tops.unionByName(done[-1].select("up", "n_leaves", "saved_tokens"))
    return reduce(DataFrame.unionByName, done)


def prefix_trie(turns: DataFrame, burst: Burst = Burst()) -> DataFrame:
    """A row for each node: each distinct sequence of the first `depth` turns that some conversation begins with.

    `turns` has (conv_id, place, total, id, bytes): the turns of each conversation by place from 0 without gaps, `total`
    their number; a conversation without turns has one row with a null place and a total of 0. Other columns take no
    part. `conv_id` is the least conversation of a node, `parent_conv_id` that of the node above (the root: null),
    `saved_tokens` the bytes that the subtree's nodes save by holding a turn once, `ends_sha256` the digest of the ids of
    the conversations that end there. No conversations make no node. Copies of a conversation meet as a count; only their
    ids, of which the digest must read every one in order, pass through one task for each node, `CHUNK` to a row.
    """
    parts = _sequences(turns.select("conv_id", "place", "total", "id", "bytes"), burst.span)
    shared = parts.where("s > 0").groupBy("head", "s").agg(F.sum("weight").alias("weight"))
    shared = stored(shared.where("weight > 1").select("head", "s"), "shared")
    # what follows a cut hangs from the one sequence that leads there
    before = parts.where("on > 0").select(F.col("next").alias("head"), F.col("least").alias("above"))
    rows = (
        parts.join(before, "head", "left")
        .join(shared.withColumn("is_shared", F.lit(True)), ["head", "s"], "left")
        .withColumns(
            {
                "up": F.lit(None).cast("string"),
                "depth": F.col("s") * burst.span,
                "last_bytes": F.lit(0).cast("long"),
                "at": F.lit(0).cast("long"),
                "level": F.when(F.col("is_shared"), F.col("s")).otherwise(0),
            }
        )
        .drop("is_shared", "own")
    )
    rows = stored(rows, "rows")
    deepest = shared.agg(F.max("s")).first()[0] or 0
    nodes, below = [], None
    for level in range(deepest, -1, -1):
        here = rows.where(F.col("level") == level).drop("level")
        # a conversation that goes on alone has one child and one leaf there and saves nothing
        alone = {"below_children": 1, "below_leaves": 1, "below_saved": 0}
        if below is None:
            here = here.withColumns({c: F.lit(v).cast("long") for c, v in alone.items()})
        else:
            here = here.join(below, "next", "left").withColumns(
                {c: F.coalesce(c, F.lit(v).cast("long")) for c, v in alone.items()}
            )
        grown = _grow(here.drop("next", "s"), burst.limit)
        tops = grown.where("inner and up is null")
        below = tops.where("depth > 0").select(
            F.col("head").alias("next"),
            F.col("n_children").alias("below_children"),
            F.col("n_leaves").alias("below_leaves"),
            F.col("saved_tokens").alias("below_saved"),
        )
        nodes.append(grown.where("not (inner and up is null and depth > 0)"))
    names = [part.split()[0] for part in NODE.split(", ")]
    return reduce(DataFrame.unionByName, nodes).select(*names)
