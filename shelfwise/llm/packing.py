"""Pack documents into sequences: shortest pack first, over the histogram of lengths."""

from __future__ import annotations

import json
import math
import os
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.arrow import slices
from shelfwise.llm.chunks import ChunkEncoder
from shelfwise.llm.storage import stored

CAPACITY = 2048
END = 1
RANK_GROUP = 256  # pieces that are ranked together
LATIN = "\u0250"  # characters before it are of old in every table of character classes

_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each process, by the tokenizer file."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        ranks = _by_ranks(path)

        def encode(text: str) -> bytes:
            if ranks is not None and max(text) < LATIN and "<|" not in text:
                ids = ranks.encode_ordinary(text)
            else:
                ids = tokenizer.encode(text, add_special_tokens=False).ids
            return array("I", ids).tobytes()

        _encoders[path] = ChunkEncoder(encode)
    return _encoders[path]


def _by_ranks(path: str) -> tiktoken.Encoding | None:
    """The same merges as ranks, if the file numbers its tokens in the order of its merges. That library is several
    times faster on short strings; both split Latin letters, digits and marks alike."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = model["vocab"]
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(vocabulary.get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def pieces(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end: int = END, keep_ids: bool = True,
) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of `capacity` and a rest.

    (doc_id, start, length, ids_crc32, doc_tokens, salt) and, if wanted, the ids. A null text is empty: one end id."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", *["ids"] * keep_ids]

    def run(batches):
        own = encoder(path)
        last = np.uint32(end).tobytes()
        row = 0
        for batch in slices(batches, "text"):
            rows, columns = [], [[] for _ in names[1:]]
            for i, value in enumerate(batch.column("text").to_pylist()):
                data = own.encode(value or "") + last
                total = len(data) // 4
                for start in range(0, total, capacity):
                    part = data[4 * start : 4 * (start + capacity)]
                    row += 1
                    values = (start, len(part) // 4, zlib.crc32(part), total, row)
                    if keep_ids:
                        values += (np.frombuffer(part, "<u4").astype(np.int32),)
                    rows.append(i)
                    for column, x in zip(columns, values, strict=True):
                        column.append(x)
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([ids, *arrays], names)

    kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long"
    return source.mapInArrow(run, schema + ", ids array<int>" * keep_ids)


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns, each a list of (length, times), and how many packs follow each.

    Lengths are placed longest first, each into the shortest packs in which there is room; equal packs are counted,
    not listed, so the work depends on the number of lengths only. Without room, new packs take as many of the length
    as fit."""
    open_packs: dict[int, dict[tuple[tuple[int, int], ...], int]] = defaultdict(dict)  # by room: patterns, counts

    def put(pattern: tuple[tuple[int, int], ...], room: int, length: int, times: int, count: int) -> None:
        if pattern and pattern[-1][0] == length:
            pattern, times_before = pattern[:-1], pattern[-1][1]
        else:
            times_before = 0
        grown = (*pattern, (length, times_before + times))
        same = open_packs[room - length * times]
        same[grown] = same.get(grown, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and (room := max(open_packs, default=0)) >= length:
            pattern, count = open_packs[room].popitem()
            some = min(count, left)
            if some < count:
                open_packs[room][pattern] = count - some
            if not open_packs[room]:
                del open_packs[room]
            put(pattern, room, length, 1, some)
            left -= some
        times = capacity // length
        if left >= times:
            put((), capacity, length, times, left // times)
        if left % times:
            put((), capacity, length, left % times, 1)
    return [(list(p), n) for room in sorted(open_packs) for p, n in open_packs[room].items()]


def slots(packs: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, times, first sequence, offset): which ranks of a length go where."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, count in packs:
        offset = 0
        for length, times in pattern:
            out.append((length, used[length], count * times, times, sequence, offset))
            used[length] += count * times
            offset += length * times
        sequence += count
    return out


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Adds each row's place among those of its length. Rows are counted in small groups by length and salt, and groups
    in blocks of as many as there are blocks; a block starts where the blocks before it end and a group where the
    groups before it in its block do. So a length that most documents share is spread over many tasks, and no task
    sums more than about the root of the number of groups."""
    groups = max(1, -(-total // RANK_GROUP))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(groups)))
    counts = rows.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("block", F.floor(F.col("group") / math.isqrt(groups)))

    def before(*keys: str, order: str) -> Column:
        rest = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(rest), F.lit(0))

    blocks = counts.groupBy("length", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("length", "block", before("length", order="block").alias("ahead"))
    firsts = counts.select("length", "block", "group", before("length", "block", order="group").alias("inside"))
    firsts = firsts.join(blocks, ["length", "block"])
    firsts = firsts.select("length", "group", (F.col("ahead") + F.col("inside")).alias("first"))
    inside = Window.partitionBy("length", "group").orderBy("doc_id", "start", "salt", "ids_crc32")
    rows = rows.withColumn("place", F.row_number().over(inside) - 1)
    return rows.join(firsts, ["length", "group"]).withColumn("rank", F.col("first") + F.col("place"))


def pack(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end: int = END, keep_ids: bool = True,
) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) and its ids.

    Null and empty texts are one end id; repeated rows are packed each; an empty table gives an empty one; other
    columns are ignored, whatever their names. A text of any length is cut into as many pieces as it needs; the worker
    holds one such text and its ids at a time. Only the histogram, at most `capacity` counts, comes to the driver, and only the slots, whose
    number the capacity bounds, are broadcast.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, path, id_column, text, capacity, end, keep_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    table = spark.createDataFrame(
        slots(pack_lengths(histogram, capacity)),
        "length long, from long, ranks long, times long, sequence long, at long",
    )
    by_length = table.groupBy("length").agg(F.collect_list(F.struct("from", "ranks", "times", "sequence", "at")).alias("slots"))
    placed = ranked(rows, sum(histogram.values())).join(F.broadcast(by_length), "length")
    rank = F.col("rank")
    own = F.filter("slots", lambda s: (rank >= s["from"]) & (rank < s["from"] + s["ranks"]))[0]
    placed = placed.withColumn("slot", own).withColumn("turn", rank - F.col("slot.from"))
    times = F.col("slot.times")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("slot.sequence") + F.floor(F.col("turn") / times)).cast("long").alias("sequence_id"),
        (F.col("slot.at") + F.pmod("turn", times) * F.col("length")).cast("long").alias("offset"),
        *["ids"] * keep_ids,
    )
