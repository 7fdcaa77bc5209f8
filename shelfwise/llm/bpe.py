"""Byte-level BPE: merges as a lazily determinised transducer, and a decoder that may stop anywhere in a character."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import map_slices
from shelfwise.llm.chunks import Kept

STATES = 150_000  # the transducer starts anew beyond, or beyond so many steps
STEPS = 300_000
PAIRS = 400_000  # of tokens whose agreement is kept
KEPT_BYTES = 64 << 20  # of pieces and their ids
KEPT_SIZE = 64  # characters; longer ones are encoded each time
ENTRY_BYTES = 160  # of an entry besides what its key and value hold
DECODE_STEP = 4096  # ids
START, NONE = -1, -2  # instead of a token: where the string begins, and where no token matters any more


class Transducer:
    """Ids of a byte string under merge ranks, in one pass.

    The ids of every prefix are those of a shorter prefix and one last token, and a sequence is an encoding if and only
    if each pair of neighbours is: so the last token after a byte is the one token ending there that agrees with the
    last token where it begins. Tokens still to come can only begin where a token's prefix is open. A state is the
    longest open prefix (a node of the trie of tokens) and the last tokens at the places from which an encoding may go
    on, counted back from the end. What all of these share is certain and is put out at once; a token waits for the
    bytes that the longest token may still take. States and steps are made when first met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.agree: dict[int, bool] = {}  # by left * size + right
        self._build_trie()
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, tuple[int, ...]]] = [(0, (START,))]
        self.numbers = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state and byte: next state, ids put out
        self.ends: dict[int, tuple[int, ...]] = {}

    def _build_trie(self) -> None:
        """Nodes are numbers; an edge is found by node and byte."""
        self.edges: dict[int, int] = {}
        self.depth, self.token = array("i", [0]), array("i", [START])
        self.tokens: list[bytes] = [b""] * self.size
        # of the merge that makes a token: its parts, and itself by its parts; single bytes have none
        self.left, self.right = array("i", [NONE]) * self.size, array("i", [NONE]) * self.size
        self.pairs: dict[int, int] = {}
        layers: list[list[tuple[int, int, int]]] = []
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            if len(token) > 1:
                parts = self.merge(token, 2)
                if len(parts) > 2:
                    continue  # no merges lead to it
                self.left[rank], self.right[rank] = parts
                self.pairs[parts[0] * self.size + parts[1]] = rank
            node = 0
            for at, byte in enumerate(token):
                child = self.edges.get(node << 8 | byte)
                if child is None:
                    child = self.edges[node << 8 | byte] = len(self.depth)
                    self.depth.append(at + 1)
                    self.token.append(NONE)
                    if at == len(layers):
                        layers.append([])
                    layers[at].append((node, byte, child))
                node = child
            self.token[node] = rank
        # parts come before what is made of them, unless the ranks aren't those of merges
        self.ordered = all(max(self.left[r], self.right[r]) < r for r in self.pairs.values())
        self.lengths = array("i", map(len, self.tokens))
        self.fallback = array("i", [0]) * len(self.depth)
        self.inner = bytearray(len(self.depth))  # whether longer tokens begin with the node
        for layer in layers:
            for node, byte, child in layer:
                self.inner[node] = 1
                if node:
                    self.fallback[child] = self._next(self.fallback[node], byte)
        self.suffixes: dict[int, tuple[int, tuple[tuple[int, int], ...], tuple[int, ...]]] = {}

    def _next(self, node: int, byte: int) -> int:
        edges = self.edges
        while True:
            child = edges.get(node << 8 | byte)
            if child is not None:
                return child
            if not node:
                return 0
            node = self.fallback[node]

    def merge(self, data: bytes, fewest: int = 1) -> list[int]:
        """The definition: the pair with the lowest rank is merged, the leftmost first, while more than `fewest` parts
        are left. Used on tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > fewest:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _agrees(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together: going back in the order of
        merges, no two parts that meet where the tokens do would have been merged before one of them was used up."""
        if len(self.agree) > PAIRS:
            self.agree.clear()
        if self.ordered:
            a, b, before = left, right, self.size
            while True:
                made = self.pairs.get(a * self.size + b)
                if made is not None and made < before:
                    same = False
                    break
                last_a, last_b = (a if self.left[a] >= 0 else -1), (b if self.left[b] >= 0 else -1)
                if last_a > last_b:
                    before, a = a, self.right[a]
                elif last_b >= 0:
                    before, b = b + 1, self.left[b]  # of equal merges the left one comes first
                else:
                    same = True
                    break
        else:
            same = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        self.agree[left * self.size + right] = same
        return same

    def _suffixes(self, node: int) -> tuple[int, tuple[tuple[int, int], ...], tuple[int, ...]]:
        """Of the suffixes that are nodes: the longest that longer tokens begin with, those that are tokens, longest
        first, as (size, token), and the sizes of those that longer tokens begin with."""
        tokens, sizes, suffix, longest = [], [0], node, 0
        while suffix:
            if self.token[suffix] >= 0:
                tokens.append((self.depth[suffix], self.token[suffix]))
            if self.inner[suffix]:
                sizes.append(self.depth[suffix])
                longest = longest or suffix
            suffix = self.fallback[suffix]
        found = self.suffixes[node] = longest, tuple(tokens), tuple(sizes)
        return found

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Places are counted back from the end of what is read; the farthest is the one that all encodings pass."""
        node, last = self.states[number]
        node = self._next(node, byte)
        node, tokens, sizes = self.suffixes.get(node) or self._suffixes(node)
        for size, token in tokens:
            before = last[size - 1]
            if before < 0:
                break
            same = self.agree.get(before * self.size + token)
            if self._agrees(before, token) if same is None else same:
                break
        last = (token, *last)
        end, lengths = len(last) - 1, self.lengths
        # the places that the encodings pass, as bits: what all share, and what any needs
        every, some = -1, 0
        for place in sizes:
            passed = 1 << end
            while place < end:
                passed |= 1 << place
                place += lengths[last[place]]
            every &= passed
            some |= passed
        shared = (every & -every).bit_length() - 1
        put, place = [], shared
        while place < end:
            put.append(last[place])
            place += lengths[last[place]]
        put.reverse()
        kept = [last[p] if some >> p & 1 else NONE for p in range(shared)]
        kept.append(last[shared] if shared in sizes else NONE)
        state = (node, tuple(kept))
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
        result = self.steps[number << 8 | byte] = (known, tuple(put))
        return result

    def _end(self, number: int) -> tuple[int, ...]:
        """What is open when the string ends."""
        last, out, place = self.states[number][1], [], 0
        while place < len(last) - 1:
            out.append(last[place])
            place += self.lengths[last[place]]
        self.ends[number] = tuple(reversed(out))
        return self.ends[number]

    def encode(self, data: bytes) -> list[int]:
        """A string that is a token is that token, whatever merges lead to; all others are read by the transducer."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        number, out, steps = 0, [], self.steps
        for byte in data:
            step = steps.get(number << 8 | byte)
            if step is None:
                if len(self.states) > STATES or len(steps) > STEPS:
                    number = self._restart(number)
                    steps = self.steps
                step = self._step(number, byte)
            number, put = step
            if put:
                out += put
        end = self.ends.get(number)
        out += self._end(number) if end is None else end
        return out

    def _restart(self, number: int) -> int:
        """Starts anew amid a string; the state it is in goes on under a new number."""
        state = self.states[number]
        self._forget()
        if state in self.numbers:
            return self.numbers[state]
        self.numbers[state] = len(self.states)
        self.states.append(state)
        return self.numbers[state]


class Utf8Machine:
    """Text of bytes that come in parts; what isn't UTF-8 becomes U+FFFD, one for each longest valid beginning."""

    def __init__(self):
        self.open = b""

    @staticmethod
    def _follows(lead: int) -> tuple[int, int, int]:
        """Bytes that follow a lead byte, and the range of the first one; a lead that can't be has -1."""
        if lead < 0x80:
            return 0, 0, 0
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return -1, 0, 0

    def _tail(self, data: bytes) -> int:
        """Where a character begins that the end of `data` leaves open; else the end."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                need, low, high = self._follows(lead)
                fits = back == 1 or low <= data[len(data) - back + 1] <= high
                return len(data) - back if need >= back and fits else len(data)
        return len(data)

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = self._tail(data)
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        text, self.open = ("�" if self.open else ""), b""
        return text


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class KeptBytes(Kept):
    """Values by chunk, within a number of bytes; emptied when full. Long chunks aren't kept."""

    def __init__(self, make: Callable[[str], bytes], most: int = KEPT_BYTES):
        super().__init__(make, most)
        self.held = 0

    def __missing__(self, chunk: str) -> bytes:
        value = self.make(chunk)
        if len(chunk) <= KEPT_SIZE:
            if self.held >= self.most:
                self.clear()
                self.held = 0
            # the widest characters take four bytes each
            self.held += ENTRY_BYTES + 4 * len(chunk) + len(value)
            self[chunk] = value
        return value


class Encoder:
    """Ids of texts by one rank file; one for each process."""

    known: dict[tuple[str, str], Encoder] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        if (path, pattern) not in cls.known:
            cls.known[path, pattern] = cls(path, pattern)
        return cls.known[path, pattern]

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.pieces = KeptBytes(lambda piece: array("I", self.transducer.encode(piece.encode())).tobytes())

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), np.uint32).astype(np.int32)


class Decoder:
    """Texts of ids by one rank file; one for each process."""

    known: dict[str, Decoder] = {}

    @classmethod
    def of(cls, path: str) -> Decoder:
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        ranks = read_ranks(path) if ranks is None else ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as far as it is certain, after each few thousand ids."""
        machine, ids = Utf8Machine(), list(ids)
        for start in range(0, len(ids), DECODE_STEP):
            yield machine.feed(b"".join(map(self.tokens.__getitem__, ids[start : start + DECODE_STEP])))
        yield machine.finish()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(row, ids) for each row of `docs`: the row as it came and the ids of its whole text. Null and empty texts have
    no ids; an empty table gives an empty one. Rows stay where they are."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = Encoder.of(path, pattern)
        ids = [encoder.encode(x or "") for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.list_(pa.int32()))], ["row", "ids"])

    return map_slices(rows, "text", run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(row, ids, decoded): adds the text of `ids`; null ids are none."""

    def run(batches):
        decoder = Decoder.of(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = ["".join(decoder.decode(x or ())) for x in part.column("ids").to_pylist()]
                arrays = [part.column("row"), part.column("ids"), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "ids", "decoded"])

    kind = encoded.schema["row"].dataType.simpleString()
    return encoded.select("row", "ids").mapInArrow(run, f"row {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(row, ids, decoded) for each row of `docs`: the ids of its whole text, and the text of these ids, in one pass
    through one worker that holds the tokens once. Null and empty texts have no ids; repeated rows are read each;
    columns of any name go along in `row`; an empty table gives an empty one. A text of any length is encoded piece by
    piece; what a worker keeps is bounded in bytes and holds no long piece."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = Encoder.of(path, pattern)
        if path not in Decoder.known:
            Decoder.known[path] = Decoder(path, encoder.transducer.ranks)
        decoder = Decoder.of(path)
        ids = [encoder.encode(x or "") for x in batch.column("text").to_pylist()]
        texts = ["".join(decoder.decode(x.tolist())) for x in ids]
        arrays = [batch.column("row"), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["row", "ids", "decoded"])

    kind = rows.schema["row"].dataType.simpleString()
    return map_slices(rows, "text", run, f"row {kind}, ids array<int>, decoded string")
