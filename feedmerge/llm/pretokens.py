"""Cutting texts where byte-level BPE pre-tokenisation can never join.

The pre-token pattern of the public byte-level vocabularies never matches a
non-space character followed by white space, so a text may be cut before any
ASCII white space that follows a non-space character: the tokens of the pieces
are the tokens of the text.  Pieces repeat a lot, so each distinct one is
encoded once per worker.
"""

from __future__ import annotations

import re

#: White space as the tokenizers' pattern has it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_PIECE = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_CUT = re.compile(r"(?<=\S)(?=[\t-\r ])")


def pieces(text: str) -> list[str]:
    """The text cut at every safe boundary; joined, they are the text."""
    if _ODD_SPACE.search(text):
        return _CUT.split(text)  # a piece may only end in a character that no pattern takes for space
    return _PIECE.findall(text)


def shrink(cache: dict, limit: int, used: set) -> None:
    """Keep a cache of more than ``limit`` entries to those of ``used``."""
    if len(cache) > limit:
        kept = {k: cache[k] for k in used if k in cache}
        cache.clear()
        cache.update(kept)


class Recent(dict):
    """A cache of two generations: when the young one has more than ``limit``
    entries it becomes the old one, and entries asked for come back from it."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def lacking(self, used: set) -> list:
        """The keys of ``used`` that the cache does not hold; it holds the others
        until the next call."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        new = []
        for key in used.difference(self):
            value = self.old.get(key)
            if value is None:
                new.append(key)
            else:
                self[key] = value
        return new


def byte_groups(texts: list[str], limit: int = 1 << 20):
    """Consecutive runs of texts of about ``limit`` characters: (first, end)."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)
