"""Secret scans: a trigram index over blocks of texts says which texts a rule can match at all; the rule then decides."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import map_slices


@dataclass(frozen=True)
class Rule:
    """Matches of `regex`, leftmost and not overlapping, whose `group` has `least` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = 3  # the first rules are the base ones

# ---------------------------------------------------------------- queries

#: A Boolean query in its normal form: one of these sets of trigrams must be there whole. ANY has an empty set.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
MOST = 64  # alternatives that are followed; beyond, a part counts as unknown


def _simple(query: set[frozenset[str]] | Query) -> Query:
    """Without sets that contain another one."""
    small = sorted(query, key=len)
    kept: list[frozenset[str]] = []
    for one in small:
        if not any(k <= one for k in kept):
            kept.append(one)
    return frozenset(kept)


def _both(a: Query, b: Query) -> Query:
    joined = _simple({x | y for x in a for y in b})
    return joined if len(joined) <= MOST else min(a, b, key=len)


def _either(a: Query, b: Query) -> Query:
    joined = _simple(a | b)
    return joined if len(joined) <= MOST else ANY


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _of_strings(strings: frozenset[str]) -> Query:
    return _simple({_trigrams(s) for s in strings})


def _flat(tree: object) -> list[tuple[frozenset[str] | None, Query]]:
    """The parts of a sequence in order, each as the set of its lowered strings if they are few, and else as a gap with
    the query that must hold within it."""
    parts: list[tuple[frozenset[str] | None, Query]] = []
    for kind, value in tree:
        if kind is op.LITERAL:
            parts.append((frozenset([chr(value).lower()]), ANY))
        elif kind is op.IN:
            parts.append((_class(value), ANY))
        elif kind is op.SUBPATTERN:
            parts += _flat(value[3]) if not _has_branch(value[3]) else [_alternatives(value[3])]
        elif kind is op.BRANCH:
            parts.append(_either_part(value[1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            strings, query = _whole(_flat(inner))
            if high == 1 and low == 0 and strings is not None:
                parts.append((strings | {""}, ANY))
            elif low == high and strings is not None and len(strings) ** low <= MOST:
                parts += _flat(inner) * low
            else:
                parts += [(strings, query)] * min(low, 3) + [(None, ANY)]
        elif kind is not op.AT:
            parts.append((None, ANY))
    return parts


def _has_branch(tree: object) -> bool:
    return any(kind is op.BRANCH for kind, _ in tree)


def _alternatives(tree: object) -> tuple[frozenset[str] | None, Query]:
    return _whole(_flat(tree))


def _either_part(branches: list) -> tuple[frozenset[str] | None, Query]:
    wholes = [_whole(_flat(b)) for b in branches]
    if all(s is not None for s, _ in wholes) and sum(len(s) for s, _ in wholes) <= MOST:
        return frozenset().union(*(s for s, _ in wholes)), ANY
    query = wholes[0][1]
    for _, other in wholes[1:]:
        query = _either(query, other)
    return None, query


def _class(items: list) -> frozenset[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 4:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= 4 else None


def _whole(parts: list[tuple[frozenset[str] | None, Query]]) -> tuple[frozenset[str] | None, Query]:
    """All strings of a sequence if they are few, and the query of its parts: neighbouring sets of strings are
    multiplied out, and where they become too many or a gap follows, their trigrams are taken."""
    query, strings, exact = ANY, frozenset([""]), True
    for part, inner in parts:
        if part is not None and len(strings) * len(part) <= MOST:
            strings = frozenset(a + b for a in strings for b in part)
            continue
        query, exact = _both(query, _of_strings(strings)), False
        query = _both(query, inner)
        strings = frozenset([""]) if part is None or len(part) > MOST else part
    return (strings if exact else None), _both(query, _of_strings(strings))


def trigram_query(regex: str) -> Query:
    """What a text, A-Z lowered, must hold for `regex` to match; ANY if nothing is certain."""
    return _whole(_flat(parser.parse(regex)))[1]


# ------------------------------------------------------------------ index


class BlockIndex:
    """Postings of a block of texts: for each trigram that some rule asks for, the sorted texts that hold it."""

    def __init__(self, trigrams: list[str]):
        self.codes = np.array([int.from_bytes(t.encode(), "big") for t in trigrams], np.int64)
        self.number = np.full(1 << 24, -1, np.int16)
        self.number[self.codes] = np.arange(len(trigrams))
        self.names = trigrams

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        if len(data) < 3:
            return {}
        lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int32)
        code = (lowered[:-2] << 16) | (lowered[1:-1] << 8) | lowered[2:]
        found = self.number[code]
        places = np.flatnonzero(found >= 0)
        rows = np.searchsorted(offsets, places, side="right") - 1
        pairs = np.unique(found[places].astype(np.int64) * len(offsets) + rows)
        which, rows = pairs // len(offsets), pairs % len(offsets)
        cuts = np.searchsorted(which, np.arange(len(self.names) + 1))
        return {t: rows[cuts[i] : cuts[i + 1]] for i, t in enumerate(self.names)}


def _candidates(query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Texts that hold one of the query's sets whole: postings are intersected, the shortest first."""
    out = np.zeros(n, bool)
    none = np.empty(0, np.int64)
    for together in query:
        if not together:
            return np.arange(n)
        lists = sorted((postings.get(t, none) for t in together), key=len)
        rows = lists[0]
        for more in lists[1:]:
            rows = np.intersect1d(rows, more, assume_unique=True)
        out[rows] = True
    return np.flatnonzero(out)


def matcher(rule: Rule) -> Callable[[str], list[tuple[int, int]]]:
    compiled = re.compile(rule.regex)

    def find(text: str) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]

    return find


def _fast(rule: Rule) -> Rule:
    """A run of one class that is too short fails from wherever it is begun, so its length may go into the regex."""
    run = re.fullmatch(r"(?P<head>\w*)(?P<class>\[[^\]]+\])\+", rule.regex)
    if rule.group or not run:
        return rule
    least = max(1, rule.least - len(run["head"]))
    return Rule(rule.kind, f"{run['head']}{run['class']}{{{least},}}", 0, rule.least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(row, found) for each row of `docs`: the row as it came and its spans (kind's number, start, end) in code points,
    by start and kind.

    A slice of rows is a block. Its index has postings for the trigrams of the rules' queries; a rule without mandatory
    trigrams reads every text. Whole texts are read in place, nothing is shuffled. A null text is empty and has no
    spans; repeated rows get the same; an empty table gives an empty one. Other columns stay inside `row`,
    whatever their names, and a very long text is a slice of its own.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    queries = [trigram_query(r.regex) for r in rules]
    trigrams = sorted({t for q in queries for s in q for t in s})
    # the least length of a match decides nothing here, but trigrams beyond ASCII can't be lowered bytewise
    usable = [t for t in trigrams if t.isascii()]
    queries = [frozenset(frozenset(t for t in s if t.isascii()) for s in q) for q in queries]

    def run(batch: pa.RecordBatch, state: dict = {}) -> pa.RecordBatch:  # noqa: B006  made once for each task
        if not state:
            state["index"] = BlockIndex(usable)
            state["find"] = [matcher(_fast(r)) for r in rules]
        texts = batch.column("text").cast(pa.large_string())
        values = texts.to_pylist()
        found: list[list[tuple[int, int, int]]] = [[] for _ in values]
        encoded = [(v or "").encode() for v in values]
        offsets = np.cumsum([0, *map(len, encoded)])[:-1]
        postings = state["index"].postings(np.frombuffer(b"".join(encoded), np.uint8), offsets)
        for k, (query, find) in enumerate(zip(queries, state["find"], strict=True)):
            for i in _candidates(query, postings, len(values)).tolist():
                if values[i]:
                    found[i] += [(start, k, end) for start, end in find(values[i])]
        spans = [[{"s": s, "k": k, "e": e} for s, k, e in sorted(x)] for x in found]
        kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, kind)], ["row", "found"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, found array<struct<s:int,k:int,e:int>>"
    return map_slices(rows, "text", run, schema)
