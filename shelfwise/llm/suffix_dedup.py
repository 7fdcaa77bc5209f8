"""Bytes covered by long strings that occur twice: suffix arrays over shards of the text that can repeat at all."""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import map_slices
from shelfwise.llm.storage import stored

SHARD = 256  # segments in a shard, about
LONGEST_RUN = 1024  # starts in a segment
PRINT = 16  # bytes of a fingerprint


@dataclass(frozen=True)
class Repeats:
    """A string of `length` bytes is a repeat if it also starts anywhere else. `gram` bytes make an anchor; both only
    trade work, since every string of `length` bytes has the anchor of its least gram."""

    length: int = 400

    @property
    def gram(self) -> int:
        """A power of two of at most a sixth of the length, so that anchors lie far apart."""
        return 1 << max(0, (max(1, self.length // 6)).bit_length() - 1)


# ------------------------------------------------------------- anchors


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each place on, from hashes of halves."""
    hashes = data.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < gram:
        mixed = hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + hashes[step:]
        hashes = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        step *= 2
    return hashes ^ (hashes >> np.uint64(32))


def _least_in_window(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of the `window` values from each place on."""
    width = 1
    while 2 * width <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = window - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchored_runs(data: np.ndarray, how: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, starts, times): runs of starts whose strings have the same least gram, and whether that
    gram stands there once or more often. Equal strings have equal anchors, at the same place within them."""
    if len(data) < how.length:
        none = np.empty(0, np.int64)
        return none, none, none, none
    hashes = _gram_hashes(data, how.gram)
    place = np.uint64((1 << 32) - 1)
    ordered = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    where = (_least_in_window(ordered, how.length - how.gram + 1) & place).astype(np.int64)
    least = hashes[where]
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(new, len(least)))
    times = 1 + (where[new + size - 1] != where[new])
    parts = -(-size // LONGEST_RUN)
    which = np.repeat(np.arange(len(new)), parts)
    part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = new[which] + part * LONGEST_RUN
    count = np.minimum(LONGEST_RUN, new[which] + size[which] - first)
    return least[first].view(np.int64), first, count, times[which]


def segments(docs: DataFrame, how: Repeats) -> DataFrame:
    """(doc_id, text_key, anchor, print, start, starts, times): a segment is the bytes that the strings of a run cover, named
    by its anchor and the digest of its bytes."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, anchors, prints, firsts, counts, times = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text")):
            data = text.as_buffer() if text.is_valid else b""
            found = anchored_runs(np.frombuffer(data, np.uint8), how)
            for anchor, first, count, often in zip(*(x.tolist() for x in found), strict=True):
                rows.append(i)
                anchors.append(anchor)
                prints.append(_digest(data[first : first + count + how.length - 1]))
                firsts.append(first)
                counts.append(count)
                times.append(often)
        rows = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(rows),
                batch.column("text_key").take(rows),
                pa.array(anchors, pa.int64()),
                pa.array(prints, pa.binary()),
                pa.array(firsts, pa.int32()),
                pa.array(counts, pa.int32()),
                pa.array(times, pa.int32()),
            ],
            ["doc_id", "text_key", "anchor", "print", "start", "starts", "times"],
        )

    schema = "doc_id long, text_key binary, anchor long, print binary, start int, starts int, times int"
    return map_slices(docs, "text", cut, schema)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=PRINT).digest()


# -------------------------------------------------------- suffix arrays


def suffix_array(data: np.ndarray, length: int) -> np.ndarray:
    """Places of `data` in the order of the `length` bytes that follow them, by Larsson-Sadakane refinement: groups of
    equal prefixes are split by the ranks of what follows, the known prefix doubles, and single ones are left alone.
    The last step overlaps the one before it, so that no byte beyond `length` counts."""
    n = len(data)
    # nine bits a byte, since the end of the data comes before every byte
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    known = min(7, length)
    for i in range(known):
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ranks = np.empty(n + 1, np.int64)
    ranks[n] = -1
    ranks[order] = _group_starts(key[order])
    active = np.flatnonzero(_in_groups(ranks[order]))
    while known < length and len(active):
        shift = min(known, length - known)
        places = order[active]
        pairs = (ranks[places] << 32) + (ranks[np.minimum(places + shift, n)] + 1)
        sort = np.argsort(pairs, kind="stable")
        places, pairs = places[sort], pairs[sort]
        order[active] = places
        # a group keeps its place, so its first member's place is its rank
        new = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        ranks[places] = active[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        active = active[_in_groups(ranks[places])]
        known += shift
    return order


def _group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _in_groups(ranks: np.ndarray) -> np.ndarray:
    same = ranks[1:] == ranks[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same])


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each place of the order, the common prefix of its suffix and the one before it, up to `limit`.

    By Kasai's rule a suffix whose predecessor in the order is the next of its left neighbour's has one byte less in
    common, if the left neighbours share their first byte; only the others are compared, eight bytes at a time."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (data[:-1] == data[before[:-1]])
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n + 1, np.uint64)
    for i in range(8):
        words[:n] = (words[:n] << np.uint64(8)) | padded[i : i + n]
    own = np.zeros(n, np.int64)
    heads = np.flatnonzero(~follows & (before >= 0))
    # a chain loses a byte at each step, so its head must be known beyond the limit
    chain = np.flatnonzero(~follows)
    reach = np.zeros(n, np.int64)
    reach[chain] = limit + np.diff(np.append(chain, n))
    at, size = heads, np.zeros(len(heads), np.int64)
    while len(at):
        a, b = at + size, before[at] + size
        inside = (a + 8 <= n) & (b + 8 <= n) & (size < reach[at])
        same = inside & (words[np.minimum(a, n)] == words[np.minimum(b, n)])
        ended = at[~same]
        tail = size[~same]
        own[ended] = tail + _same_bytes(data, ended + tail, before[ended] + tail)
        at, size = at[same], size[same] + 8
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    prefix = own[start] - (np.arange(n) - start)
    return np.minimum(prefix, limit)[order]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of up to eight bytes agree from places a and b on."""
    n, count = len(data), np.zeros(len(a), np.int64)
    open_ = np.ones(len(a), bool)
    for i in range(8):
        x, y = a + i, b + i
        open_ &= (x < n) & (y < n)
        open_[open_] = data[x[open_]] == data[y[open_]]
        count += open_
    return count


def repeated_starts(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of segments laid end to end: (segment, offset, class, repeated) of each start of a string of `length` bytes.
    Strings of a class are equal; a class of two or more is repeated."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    segment = np.repeat(np.arange(len(parts)), sizes)
    offset = np.arange(len(data)) - (ends - sizes)[segment]
    whole = offset + length <= sizes[segment]
    order = suffix_array(data, length)
    prefix = common_prefixes(data, order, length)
    # of the order, keep starts of whole strings; two are equal if all prefixes between them reach the length
    classes = np.cumsum(prefix < length)
    keep = whole[order]
    places, classes = order[keep], classes[keep]
    same = np.concatenate([classes[1:] == classes[:-1], [False]])
    return segment[places], offset[places], classes, same | np.concatenate([[False], same[:-1]])


# ---------------------------------------------------------------- shards


def _runs(offsets: np.ndarray) -> bytes:
    """Sorted offsets as pairs of first and count."""
    if not len(offsets):
        return b""
    new = np.flatnonzero(np.concatenate([[True], np.diff(offsets) != 1]))
    return np.stack([offsets[new], np.diff(np.append(new, len(offsets)))], axis=1).astype("<i4").tobytes()


SHARD_ROWS = "anchor long, print binary, runs binary, bucket int, shard long, strings binary, owners binary, offsets binary"


def _solve_shard(how: Repeats):
    def solve(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        parts = table.column("data").to_pylist()
        anchors, prints = table.column("anchor").to_numpy(), table.column("print").to_pylist()
        weights, splits = table.column("n").to_numpy(), table.column("parts").to_numpy()
        segment, offset, classes, repeated = repeated_starts(parts, how.length)
        repeated |= weights[segment] > 1
        rows = []
        by_segment = np.lexsort((offset, segment))
        for i, own in enumerate(np.split(by_segment, np.searchsorted(segment[by_segment], np.arange(1, len(parts))))):
            runs = _runs(offset[own[repeated[own]]])
            if runs:
                rows.append((anchors[i], prints[i], runs, None, None, None, None, None))
        # of an anchor that other shards hold too: one string of each class, for the shards to be merged
        some = np.flatnonzero(splits[segment] > 1)
        some = some[np.unique(classes[some], return_index=True)[1]]
        buckets: dict[tuple[int, int], list[tuple[bytes, bytes, int]]] = {}
        for x in some.tolist():
            i, at = segment[x], int(offset[x])
            string = _digest(parts[i][at : at + how.length])
            bucket = int.from_bytes(string[:4], "little") % int(splits[i])
            entry = (string, b"" if repeated[x] else prints[i], at)
            buckets.setdefault((int(anchors[i]), bucket), []).append(entry)
        for (anchor, bucket), entries in buckets.items():
            entries.sort()
            owners = b"".join(e[1] or bytes(PRINT) for e in entries)
            offsets = np.array([e[2] if e[1] else -1 for e in entries], "<i4").tobytes()
            rows.append((anchor, None, None, bucket, shard, b"".join(e[0] for e in entries), owners, offsets))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["anchor", "print", "runs", "bucket", "shard", "strings", "owners", "offsets"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return solve


def _merge_shards(key: tuple, table: pa.Table) -> pa.Table:
    """Strings that two shards hold, by binary search of each shard's sorted strings in the others'."""
    anchor = key[0].as_py()
    strings = table.column("strings").to_pylist()
    heads = [np.frombuffer(x, ">u8")[::2].astype(np.uint64) for x in strings]
    everything = np.sort(np.concatenate(heads))
    hits = []
    for own in heads:
        times = np.searchsorted(everything, own, "right") - np.searchsorted(everything, own, "left")
        hits.append(np.flatnonzero(times > 1).tolist())
    held = Counter(x[PRINT * i : PRINT * (i + 1)] for x, own in zip(strings, hits, strict=True) for i in own)
    found: dict[bytes, list[int]] = {}
    columns = (strings, hits, table.column("owners").to_pylist(), table.column("offsets").to_pylist())
    for x, own, owners, offsets in zip(*columns, strict=True):
        places = np.frombuffer(offsets, "<i4")
        for i in own:
            if places[i] >= 0 and held[x[PRINT * i : PRINT * (i + 1)]] > 1:
                found.setdefault(owners[PRINT * i : PRINT * (i + 1)], []).append(int(places[i]))
    prints = list(found)
    return pa.table(
        {
            "anchor": pa.array([anchor] * len(prints), pa.int64()),
            "print": pa.array(prints, pa.binary()),
            "runs": pa.array([_runs(np.array(sorted(found[p]))) for p in prints], pa.binary()),
        }
    )


def _with_key(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("text_key", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))


def repeated_runs(docs: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """(text_key, found): for each distinct text with repeats, the runs of starts of repeated strings.

    `docs` has doc_id, text and text_key. A string can only repeat if its anchor occurs twice, so what goes to shards
    is one copy of each distinct segment under such an anchor; a shard holds about SHARD segments, and an anchor with
    more is split over several, whose strings are then merged."""
    every = stored(segments(docs, how), "segments")
    twice = every.groupBy("anchor").agg(F.sum("times").alias("n")).where(F.col("n") > 1).select("anchor")
    candidates = stored(every.join(twice, "anchor"), "candidates")
    classes = candidates.groupBy("anchor", "print").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "doc_id", "start", "starts")).alias("at")
    )
    classes = stored(classes, "classes")
    parts = classes.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"))
    wanted = classes.join(parts, "anchor").select("anchor", "print", "n", "parts", "at.*")
    wanted = wanted.groupBy("text_key", F.col("doc_id").alias("own")).agg(
        F.collect_list(F.struct("anchor", "print", "n", "parts", "start", "starts")).alias("cuts")
    )
    same = (docs["text_key"] == wanted["text_key"]) & docs["doc_id"].eqNullSafe(wanted["own"])
    texts = docs.join(wanted, same).select("text", "cuts")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, cuts in zip(batch.column("text"), batch.column("cuts").to_pylist(), strict=True):
            data = text.as_buffer()
            for x in cuts:
                end = x["start"] + x["starts"] + how.length - 1
                out.append((x["anchor"], x["print"], x["n"], x["parts"], data[x["start"] : end].to_pybytes()))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "print", "n", "parts", "data"]
        )

    pieces = map_slices(texts, "text", cut, "anchor long, print binary, n long, parts int, data binary")
    pieces = pieces.dropDuplicates(["anchor", "print"])
    shards = max(1, classes.count() // SHARD)
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("print"), "parts")).otherwise(0)
    shard = F.pmod(F.xxhash64("anchor", part), F.lit(shards)).alias("shard_key")
    solved = stored(pieces.withColumn("shard_key", shard).groupBy("shard_key").applyInArrow(_solve_shard(how), SHARD_ROWS), "shards")
    merged = (
        solved.where(F.col("strings").isNotNull())
        .groupBy("anchor", "bucket")
        .applyInArrow(_merge_shards, "anchor long, print binary, runs binary")
    )
    runs = solved.where(F.col("runs").isNotNull()).select("anchor", "print", "runs").union(merged)
    places = candidates.select("text_key", "anchor", "print", "start").distinct().join(runs, ["anchor", "print"])
    return places.groupBy("text_key").agg(F.collect_list(F.struct("start", "runs")).alias("found"))


def _removed(found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that repeated strings cover."""
    spans = []
    for x in found or ():
        for first, count in np.frombuffer(x["runs"], "<i4").reshape(-1, 2).tolist():
            spans.append((x["start"] + first, x["start"] + first + count - 1 + length))
    spans.sort()
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(
    docs: DataFrame, how: Repeats = Repeats(), id_column: str = "doc_id", text: str = "text", as_text: bool = False
) -> DataFrame:
    """(row, kept, n_bytes, n_removed, spans) for each row of `docs`: the row as it came, the UTF-8 bytes that are
    left of its whole text, and the removed spans. `kept` as text leaves out characters that a cut splits.

    Null and empty texts, and those shorter than the length, keep all they have, an empty string for null. Repeated
    rows are copies of each other, so what is long enough in them goes. An empty table gives an empty one.
    """
    source = _with_key(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")), "text")
    found = stored(repeated_runs(source, how), "found")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _with_key(rows, "text").join(found, "text_key", "left").drop("text_key")

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, sizes, removed, spans = [], [], [], []
        for text, runs in zip(batch.column("text"), batch.column("found").to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            out = _removed(runs, how.length)
            left, at = [], 0
            for start, end in out:
                left.append(data[at:start])
                at = end
            kept.append(b"".join([*left, data[at:]]))
            if as_text:
                kept[-1] = kept[-1].decode("utf-8", "ignore")
            sizes.append(len(data))
            removed.append(sum(b - a for a, b in out))
            spans.append([{"start": a, "end": b} for a, b in out])
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array(kept, pa.string() if as_text else pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, span),
            ],
            ["row", "kept", "n_bytes", "n_removed", "spans"],
        )

    kind = rows.schema["row"].dataType.simpleString()
    return map_slices(
        rows, "text", remove,
        f"row {kind}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>",
    )


def cut_repeats(docs: DataFrame, how: Repeats, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the repeats cut out of its texts; a character that a cut splits goes with it. Null stays null."""
    columns = docs.columns
    out = remove_repeats(docs, how, id_column, text, as_text=True)
    own = F.col("row")[text]
    left = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(own)
    return out.select(*[(left if c == text else F.col("row")[c]).alias(c) for c in columns])
