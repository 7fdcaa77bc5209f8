"""Cut texts where no token can cross, so that what was found for a chunk can be kept for the next time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

# Before a single space between two non-spaces starts a token of every byte-level pattern used here (" ?\p{L}+" and
# the like), and a single line feed between two non-spaces is a token of its own.
CUT = re.compile(r"(?<=\S)(?= \S)")
PAIRS = ("  ", " \n", "\n ", "\n\n")
# fixed values: the other characters that Python counts as white space
OTHER_SPACE = (
    "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0            "
    "    　"
)
CACHE = 100_000


class Kept(dict):
    """Values by chunk, made when they are first asked for; emptied when full."""

    def __init__(self, make: Callable[[str], bytes], most: int = CACHE):
        self.make, self.most = make, most

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self[chunk] = self.make(chunk)
        return value


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, by an encoder of strings."""

    def __init__(self, encode: Callable[[str], bytes], most: int = CACHE):
        self.plain = Kept(encode, most)
        self.spaced = Kept(lambda word: encode(" " + word), most)

    def parts(self, text: str) -> Iterator[bytes]:
        even = text and not (
            text[0].isspace()
            or text[-1].isspace()
            or any(x in text for x in PAIRS)
            or any(x in text for x in OTHER_SPACE)
        )
        if not even:
            yield from map(self.plain.__getitem__, CUT.split(text) if text else ())
            return
        for i, line in enumerate(text.split("\n")):
            if i:
                yield self.plain["\n"]
            words = line.split(" ")
            yield self.plain[words[0]]
            yield from map(self.spaced.__getitem__, words[1:])

    def encode(self, text: str) -> bytes:
        return b"".join(self.parts(text))
