"""Fingerprints, prefix tries and manifests against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwise.llm import burst_trie, merkle, winnowing
from shelfwise.llm.winnowing import Winnow

HOW = Winnow()


# ------------------------------------------------------------------ fingerprints


def plain_marks(text, how=HOW):
    """(position, hash) of each mark."""
    if not text:
        return []
    grams = [text[i : i + how.gram] for i in range(max(1, len(text) - how.gram + 1))]
    codes = [xxhash.xxh64(g.encode("utf-32-be"), seed=42).intdigest() for g in grams]
    hashes = [0xFFFFFFFF - ((c >> 31) & 0xFFFFFFFF) for c in codes]
    # of a window the least hash, of equal ones the rightmost
    order = np.array([h << 31 | (2**31 - 1 - i) for i, h in enumerate(hashes)])
    windows = np.lib.stride_tricks.sliding_window_view(order, min(how.window, len(order)))
    found = {2**31 - 1 - int(x & (2**31 - 1)) for x in np.unique(windows.min(axis=1))}
    return [(i, hashes[i]) for i in sorted(found)]


def plain_written(found):
    before = [-1] + [i for i, _ in found]
    return "".join(f"{i - b:02X}{h:08X}" for (i, h), b in zip(found, before, strict=False))


def plain_likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_edited(texts):
    out = []
    for text, following in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        out.append(text[: len(text) - half] + following[:half])
    return out


def random_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["ab", "the ", "é", "漢", "🙂", "river", " ", "x" * 30, "\n"]
    return ["".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 20, 90, 400]))) for _ in range(n)]


def edited_rows(docs):
    found = winnowing.compare_edited(docs)
    return found.select(
        "row.doc_id",
        "n_chars",
        "edited",
        winnowing.written(F.col("marks")).alias("fingerprint"),
        winnowing.written(F.col("edited_marks")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        winnowing.likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


def expected_edited(values, ids):
    order = sorted(range(len(values)), key=lambda i: (ids[i] is not None, ids[i] or 0, values[i] or ""))
    texts = [values[i] or "" for i in order]
    found, edited = [plain_marks(t) for t in texts], plain_edited(texts)
    rows = []
    for at, i in enumerate(order):
        marks, following = plain_marks(edited[at]), found[(at + 1) % len(found)]
        rows.append(
            (
                ids[i], len(texts[at]), edited[at], plain_written(found[at]), plain_written(marks),
                plain_likeness(found[at], marks), plain_likeness(found[at], following),
            )
        )
    return rows


@pytest.mark.parametrize("piece", [winnowing.PIECE, 64])
def test_fingerprints(documents, texts, monkeypatch, piece):
    monkeypatch.setattr(winnowing, "PIECE", piece)
    values = [None, "", "a", "short", "a" * 500, "ab" * 300, *random_texts(piece), *list(texts.values())[:60]]
    values += values[-3:]
    ids = list(range(len(values)))
    random.Random(1).shuffle(ids)
    ids[3] = None
    got = [tuple(r) for r in edited_rows(documents(values, ids)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected_edited(values, ids)))


def test_fingerprints_of_shared_ids_and_few_rows(documents):
    long = "".join(random_texts(7))
    for values, ids in [
        ([long], [5]),
        ([long, long, long], [1, 1, 1]),
        (["b" * 90, long, None, "a" * 70], [2, None, 2, None]),
    ]:
        got = [tuple(r) for r in edited_rows(documents(values, ids)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, expected_edited(values, ids)))
    assert edited_rows(documents([])).collect() == []


def test_fingerprint_of_a_million_characters(documents):
    rng = random.Random(3)
    values = ["".join(rng.choices("abcdefgh", k=1_000_000)), "x" * 1_000_000]
    got = {r["doc_id"]: r for r in edited_rows(documents(values)).collect()}
    for row in expected_edited(values, [0, 1]):
        assert tuple(got[row[0]]) == row


def test_marks_are_sure(spark):
    """Whatever stands around it, a shared passage of `sure` code points has a mark in both texts, at its place."""
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh ", k=HOW.sure))
    pairs = []
    for _ in range(200):
        around = ["".join(rng.choices("abcdefgh ", k=rng.randrange(60))) for _ in range(4)]
        pairs.append((around[0] + passage + around[1], around[2] + passage + around[3], len(around[0]), len(around[2])))
    df = spark.createDataFrame(pairs, "a string, b string, i int, j int")
    found = df.select(
        "i", "j", *[F.transform(winnowing.marks(F.col(c), HOW), winnowing.place).alias(c) for c in "ab"]
    ).collect()
    for row in found:
        inside = range(HOW.window)
        assert {p - row["i"] for p in row["a"]} & {p - row["j"] for p in row["b"]} & set(inside)


def test_fingerprints_without_python(documents):
    plan = edited_rows(documents(["a", "b"]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert plan.split("Physical Plan")[1].count("REPARTITION_BY_COL") == 1


# ------------------------------------------------------------------ prefix trie


def conversations_of(spark, rows):
    kinds = "conv_id long, turn long, role string, text string, head string, n int, place string"
    return spark.createDataFrame([(*row, "clash", 1, "x") for row in rows], kinds)


def plain_sequences(rows, group=5, most=8):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turn_id = hashlib.sha256((f"{len(role.encode())}:" + role + text).encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0, turn_id), (role, text)))
    own = {conv: [t for _, t in sorted(turns)] for conv, turns in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % (most + 1)
        out[conv] = own.get(conv - conv % group, [])[:h] + turns[h:]
    return out


def plain_trie(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sorted(sequences.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    for prefix, convs in members.items():
        bytes_ = len(prefix[-1][1].encode()) if prefix else 0
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += prefix not in children
            saved[prefix[:d]] += (len(convs) - 1) * bytes_
    return sorted(
        (
            convs[0], len(prefix), members[prefix[:-1]][0] if prefix else None, len(convs), children.get(prefix, 0),
            leaves[prefix], saved[prefix], hashlib.sha256(",".join(map(str, ends.get(prefix, []))).encode()).hexdigest(),
        )
        for prefix, convs in members.items()
    )


def random_turns(seed, convs=40, longest=7):
    rng = random.Random(seed)
    texts = ["", None, "a", "é漢", "long text " * 5]
    rows = []
    for conv in rng.sample(range(10 * convs), convs):
        n = rng.randrange(1, longest)
        turns = [(conv, t if rng.random() > 0.1 else None, rng.choice(["user", "tool", None]), rng.choice(texts)) for t in range(n)]
        rows += turns
    # copies, a common start, repeated rows, rows of no conversation
    for conv in range(1000, 1030):
        rows += [(conv, t, "user", f"same {t}") for t in range(longest)]
        rows += [(conv, longest, "user", f"own {conv % 7}")] * (conv % 3)
    rows += [(None, 0, "user", "nobody"), (5, None, None, None), (7, 3, "user", "x"), (7, 3, "user", "x")]
    return rows


def by_depth(rows):
    return sorted(rows, key=lambda r: tuple(-1 if x is None else x for x in r[:7]) + (r[7],))


@pytest.mark.parametrize("limit, span", [(1000, 256), (1, 256), (3, 2), (2, 4)])
def test_trie(spark, limit, span):
    rows = random_turns(limit * 10 + span)
    turns = burst_trie.mixed(burst_trie.in_order(conversations_of(spark, rows)))
    got = burst_trie.prefix_trie(turns, burst_trie.Burst(limit, span)).collect()
    assert by_depth(map(tuple, got)) == by_depth(plain_trie(plain_sequences(rows)))


def test_trie_of_one_long_conversation(spark):
    """More turns than a part holds, alone and shared, and many ids at one node."""
    rows = [(0, t, "user", f"turn {t}") for t in range(700)] + [(5, t, "user", f"turn {t}") for t in range(600)]
    rows += [(5 * c, 0, "user", "hello") for c in range(10, 9000)]
    got = burst_trie.prefix_trie(burst_trie.mixed(burst_trie.in_order(conversations_of(spark, rows)))).collect()
    assert by_depth(map(tuple, got)) == by_depth(plain_trie(plain_sequences(rows)))


def test_trie_of_nothing(spark):
    turns = burst_trie.mixed(burst_trie.in_order(conversations_of(spark, [])))
    assert burst_trie.prefix_trie(turns).collect() == []


# ------------------------------------------------------------------ manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_proofs(digests):
    """The root, and for each leaf the (left, right) strings level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for leaf, node in enumerate(at):
            first = node - node % 3
            paths[leaf].append(("".join(level[first:node]), "".join(level[node + 1 : first + 3])))
        level = [digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [node // 3 for node in at]
    return level[0], paths


def plain_manifest(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    made = {name: plain_proofs([x[2] for x in sorted(sources[name], key=lambda x: x[:3])]) for name in names}
    root, tops = plain_proofs([made[name][0] for name in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        for (_, _, leaf, row), path in zip(sorted(sources[name], key=lambda x: x[:3]), made[name][1], strict=True):
            out.append((row[0], leaf, made[name][0], root, digest("".join(a + b for a, b in path + top)), path + top))
    return out


def manifest_rows(spark, rows, levels):
    docs = spark.createDataFrame(
        [(*row, "clash", 7) for row in rows],
        "doc_id long, source string, lang string, n_chars long, text string, tree string, place int",
    )
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return merkle.manifest(docs, merkle.leaf(*columns), F.col("source"), F.col("doc_id"), [F.col("doc_id")], levels)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    rows = [
        (rng.choice([None, i]) if i % 17 == 0 else i, rng.choice([None, "-", "", "é", "big", "big", "big"]), rng.choice([None, "en"]),
         rng.choice([None, i]), rng.choice([None, "", "a\nb", f"text {i}"]))
        for i in range(230)
    ]
    rows += [(1, "one", None, 3, "alone")] + [(8, "big", "en", 1, "twice")] * 3
    made = manifest_rows(spark, rows, levels)
    got = made.select(
        "row.doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256),
        merkle.folded(F.col("leaf"), F.col("path")), merkle.folded(F.lit("0" * 64), F.col("path")),
    )
    want = plain_manifest(rows)
    got = got.collect()
    # repeated rows are alike, so their places may be exchanged
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, (w[:5] for w in want)))
    for row in got:
        assert row[5] == row["root"] and row[6] != row["root"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    got = manifest_rows(spark, rows, 1).collect()
    assert sorted((r["row"]["doc_id"], r["leaf"], r["root"]) for r in got) == sorted((w[0], w[1], w[3]) for w in plain_manifest(rows))


def test_manifest_of_nothing(spark):
    assert manifest_rows(spark, [], 6).collect() == []


def test_changed_rows_are_noticed(spark, texts):
    rows = [(i, f"s{i % 3}", "en", 1, t) for i, t in texts.items()]
    made = manifest_rows(spark, rows, 2).collect()
    paths = {w[0]: (w[3], w[5]) for w in plain_manifest(rows)}
    for row in made:
        root, path = paths[row["row"]["doc_id"]]
        assert [tuple(side) for side in row["path"]] == path and row["root"] == root
