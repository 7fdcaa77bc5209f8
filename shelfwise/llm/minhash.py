"""Near-duplicate documents: MinHash bands propose pairs, odd sketches drop the unlike, full shingle sets decide."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import map_slices
from shelfwise.llm.components import components
from shelfwise.llm.storage import stored

BANDS = 32
ROWS = 5
SKETCH_WORDS = 4  # of 64 bits
BLOCK = 2048  # nodes on either side of a cell of an exhaustive comparison
CELL_BYTES = 16 << 20  # and of their sets
TURNS = 2  # of pairs with hubs
CACHE = 100_000

_rng = np.random.default_rng(20)
MULTIPLIERS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
FOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Likeness:
    """Documents are linked if `whole` * |A and B| >= `part` * |A or B| for their sets of `words`-word shingles."""

    words: int = 5
    part: int = 80
    whole: int = 100

    def most_different_bits(self) -> int:
        """Odd sketches of documents on the threshold differ in about z bits; five standard deviations above that, a
        pair is dropped unread. Of 10 million links that costs a few at most."""
        k, bits = BANDS * ROWS, 64 * SKETCH_WORDS
        unlike = 1 - self.part / self.whole
        mean = 2 * k * unlike
        stay = math.exp(-2 * mean / bits)
        z = bits / 2 * (1 - stay)
        by_sampling = 2 * stay * math.sqrt(k * unlike * (1 - unlike))
        by_folding = math.sqrt(bits / 4 * (1 - stay * stay))
        return math.ceil(z + 5 * math.hypot(by_sampling, by_folding))


class WordHashes(dict):
    """Hash of each word, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the whole text, A-Z lowered; a text with fewer words is one
    shingle, a null or blank one has none."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    n = len(tokens) - size + 1
    folded = np.full(n, size, np.uint64)
    for i in range(size):
        folded = _mixed(folded * FOLD + hashes[i : i + n])
    return np.unique(folded)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 512):
        part = shingles[start : start + 512]
        np.minimum(least, (part[:, None] * MULTIPLIERS + OFFSETS).min(axis=0), out=least)
    return least


def band_hashes(samples: np.ndarray) -> np.ndarray:
    folded = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in samples.reshape(BANDS, ROWS).T:
        folded = _mixed(folded * FOLD + column)
    return folded.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap: each sample, with its place, flips one bit."""
    bits = _mixed(samples + np.arange(len(samples), dtype=np.uint64) * FOLD) % np.uint64(64 * SKETCH_WORDS)
    parity = (np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def sketches(docs: DataFrame, words: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, node, n_shingles, bands, odd): a node is a set of shingles, named by its digest."""
    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("text_key"),
    )

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, bands, odd = [], [], [], []
        for value in batch.column("text").to_pylist():
            shingles = shingle_set(value, words)
            nodes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            sizes.append(len(shingles))
            samples = minhashes(shingles)
            bands.append(band_hashes(samples) if len(shingles) else np.empty(0, np.int64))
            odd.append(odd_sketch(samples))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(nodes, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(odd, pa.list_(pa.int64())),
            ],
            ["doc_id", "text_key", "node", "n_shingles", "bands", "odd"],
        )

    return map_slices(
        source,
        "text",
        sketch,
        "doc_id long, text_key binary, node binary, n_shingles long, bands array<long>, odd array<long>",
    )


def different_bits(a: str, b: str) -> Column:
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_WORDS)]
    return sum(bits[1:], bits[0])


def _alike(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) whose odd sketches differ in few bits."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("odd").alias(f"odd_{end}")), end)
    return pairs.where(different_bits("odd_a", "odd_b") <= most).select("a", "b")


def _star(buckets: DataFrame, labels: DataFrame | None, seen: DataFrame | None, turn: int) -> DataFrame:
    """For each node one pair, with the hub of one of its buckets that isn't yet in its component and that it hasn't
    met: as many pairs as nodes at most. The hub is the node that a hash picks, another one in each turn."""
    if labels is not None:
        buckets = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        buckets = buckets.withColumn("label", F.col("node"))
    order = F.col("node") if turn == 0 else F.unhex(F.md5(F.concat(F.col("node"), F.lit(str(turn)))))
    hubs = buckets.groupBy("bucket").agg(
        F.min(F.struct(order.alias("o"), "node", "label")).alias("hub"),
        F.min("label").alias("least"),
        F.max("label").alias("most"),
    ).where(F.col("least") != F.col("most"))
    met = buckets.join(hubs, "bucket").where(F.col("label") != F.col("hub.label"))
    if seen is not None:
        a, b = F.least("node", "hub.node"), F.greatest("node", "hub.node")
        met = met.select("node", "hub", a.alias("a"), b.alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
    first = met.groupBy("node").agg(F.min("hub")["node"].alias("hub"))
    return first.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _every(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links between different components among nodes that share a bucket.

    Buckets of one component are done. The others make families: a component counts as one node there, and in each
    bucket the others are tied to the one with most rows, so that a large settled group adds one row for each component
    that it meets, not one for each of its nodes. Each node of an open bucket is sent once for all of its buckets. A
    family is dealt into parts of at most about BLOCK nodes and CELL_BYTES of sets, and each two parts meet in a cell.
    There odd sketches drop unlike pairs, and full sets decide on the rest; what is linked already isn't compared again,
    and only links leave a cell."""
    labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    hubs = (
        groups.groupBy("bucket")
        .agg(F.max(F.struct("n", "label"))["label"].alias("hub"), F.count(F.lit(1)).alias("labels"))
        .where(F.col("labels") > 1)
        .select("bucket", "hub")
    )
    hubs = stored(hubs, "hubs")
    edges = groups.join(hubs, "bucket").where(F.col("label") != F.col("hub"))
    families = components(edges.select(F.col("label").alias("a"), F.col("hub").alias("b")).distinct())
    families = families.select(F.col("label").alias("family"), F.col("node").alias("label"))
    members = (
        labelled.join(hubs.select("bucket"), "bucket", "left_semi")
        .groupBy("node")
        .agg(F.first("label").alias("label"))
        .join(families, "label")
        .join(sets, "node")
    )
    parts = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("shingles")) / CELL_BYTES)
    sizes = members.groupBy("family").agg(F.ceil(parts).cast("int").alias("parts"))
    placed = (
        members.join(sizes, "family")
        .join(nodes.select("node", "odd"), "node")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "family",
            F.least("part", "other").alias("row"),
            F.greatest("part", "other").alias("column"),
            "part",
            "node",
            "label",
            "odd",
            "shingles",
        )
    )
    most = like.most_different_bits()

    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").to_pylist()
        # unsigned: of a negative number, numpy counts the bits of the absolute
        odd = np.array(table.column("odd").to_pylist(), dtype=np.int64).view(np.uint64).reshape(-1, SKETCH_WORDS)
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        size = np.array([len(x) for x in full])
        label = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
        part = table.column("part").to_numpy()
        row, column = table.column("row")[0].as_py(), table.column("column")[0].as_py()
        left, right = np.flatnonzero(part == row), np.flatnonzero(part == column)
        links = []
        for place, i in enumerate(left):
            others = right[place + 1 :] if row == column else right
            others = others[label[others] != label[i]]
            bits = np.bitwise_count(odd[others] ^ odd[i]).sum(axis=1, dtype=np.int64)
            others = others[bits <= most]
            some = [others[k : k + 256] for k in range(0, len(others), 256)]
            for near in some:
                near = near[label[near] != label[i]]
                if not len(near):
                    continue
                ends = np.cumsum(size[near])
                joined = np.concatenate([full[j] for j in near])
                at = np.minimum(np.searchsorted(full[i], joined), size[i] - 1)
                both = np.add.reduceat((full[i][at] == joined).astype(np.int64), ends - size[near])
                for j in near[like.whole * both >= like.part * (size[i] + size[near] - both)].tolist():
                    if label[j] != label[i]:
                        links.append((node[i], node[j]))
                        label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    return placed.groupBy("family", "row", "column").applyInArrow(compare, "a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs whose full sets reach the threshold. The other nodes of a hub are dealt over groups of
    about 64, each with the hub's set."""
    # the end with more pairs is the hub
    often = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).groupBy("node").count()
    for end in ("a", "b"):
        pairs = pairs.join(often.select(F.col("node").alias(end), F.col("count").alias(f"n_{end}")), end)
    first = F.col("n_a") >= F.col("n_b")
    pairs = pairs.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"),
        F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("n"),
    )
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / 64)).cast("int")
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    held = sets.select("node", "shingles")
    hubs = pairs.select("hub", "part").distinct().join(held.withColumnRenamed("node", "hub"), "hub").select(
        "hub", "part", F.col("hub").alias("node"), "shingles"
    )
    others = pairs.join(held, "node").select("hub", "part", "node", "shingles")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        hub = key[0].as_py()
        nodes = table.column("node").to_pylist()
        arrays = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        own = arrays[nodes.index(hub)]
        linked = []
        for node, shingles in zip(nodes, arrays, strict=True):
            if node == hub:
                continue
            both = len(np.intersect1d(own, shingles, assume_unique=True))
            if like.whole * both >= like.part * (len(own) + len(shingles) - both):
                linked.append(node)
        return pa.table({"a": pa.array([hub] * len(linked), pa.binary()), "b": pa.array(linked, pa.binary())})

    return hubs.union(others).groupBy("hub", "part").applyInArrow(compare, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, text: str) -> DataFrame:
    """(node, shingles) of the wanted nodes, made again from one text of each."""
    texts = docs.select(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("text_key"), F.col(text).alias("text"))
    source = texts.join(wanted, "text_key").select("node", "text")

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, words).tobytes() for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    made = map_slices(source, "text", shingles, "node binary, shingles binary")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def near_duplicates(
    docs: DataFrame, like: Likeness = Likeness(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`, by whole texts.

    Rows with equal sets are one node from the start. Bands of MinHash samples propose pairs: first each node with a
    hub of its buckets, again with other hubs where a bucket still holds several components, and then whatever pairs
    of different components are left, so that no link between components is missed beyond the bands' own chance
    ((1 - s^5)^32: 7e-9 at s = 0.85, 3e-6 at 0.8). Odd sketches drop unlike pairs before sets are read; full sets
    decide.

    Null and blank texts have no shingles and are linked with nothing: their component is their own id. Repeated rows
    share a component. The component of texts without any id is null, and a row is kept if its id is the component's,
    null for null. An empty table gives an empty one; other columns are ignored, whatever their names. Of a very long
    text all shingles count.
    """
    rows = stored(sketches(docs, like.words, id_column, text), "sketches")
    filled = rows.where(F.col("n_shingles") > 0)
    nodes = stored(
        filled.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.first("bands").alias("bands"),
            F.first("odd").alias("odd"),
        ),
        "nodes",
    )
    exploded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("bucket")
    buckets = stored(exploded.join(shared, "bucket").select("bucket", "node"), "buckets")
    wanted = buckets.select("node").distinct().join(nodes, "node").select("text_key", "node")
    sets = stored(_sets(docs, wanted, like.words, text), "sets")

    links = labels = seen = None
    for turn in range(TURNS):
        pairs = stored(_star(buckets, labels, seen, turn), "star")
        seen = pairs if seen is None else seen.union(pairs)
        found = stored(_confirmed(_alike(pairs, nodes, like.most_different_bits()), sets, like), "confirmed")
        links = found if links is None else links.union(found)
        labels = components(links)
    labels = components(links.union(stored(_every(buckets, labels, nodes, sets, like), "every")))

    named = nodes.select("node", F.col("doc_id").alias("own")).join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("own").alias("component_id"))
    ids = named.join(least, "label").select("node", "component_id")
    result = filled.select("doc_id", "n_shingles", "node").join(ids, "node").select("doc_id", "n_shingles", "component_id")
    blank = rows.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.union(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(
    docs: DataFrame, like: Likeness = Likeness(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents that stand for their group, all columns as they came. Of rows that repeat an id and a text one
    stays."""
    kept = near_duplicates(docs, like, id_column, text).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("__text")
    rows = docs.withColumn("__text", key)
    rows = rows.join(kept, rows[id_column].cast("long").eqNullSafe(F.col("__kept")), "left_semi")
    return rows.dropDuplicates([id_column, "__text"]).drop("__text")
