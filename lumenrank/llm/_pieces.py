"""Encoding whole texts piece by piece, with the pieces met before kept in memory.

No match of a byte-level pattern spans a change from non-space to space, so a text may be cut
before every run of white space and the pieces encoded alone. Most runs are one blank, where
``str.split`` does the cutting; texts with other runs next to blanks are cut by a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

_ODD = re.compile(r" \s|\s ")  # white space next to a blank
_MARKS = frozenset(".,;:!?")
_UNIT = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")


class Memo:
    """Two generations: when the newer is full the older goes, and what is asked for again stays."""

    def __init__(self, keep: int):
        self.keep, self.new, self.old = keep, {}, {}

    def room(self, n: int) -> dict:
        """The newer generation, with room for n more."""
        if len(self.new) + n > self.keep and self.new:
            self.old, self.new = self.new, {}
        return self.new

    def missing(self, keys: list[str]) -> list[str]:
        """Those of the keys that neither generation has; the others are in the newer then."""
        out, new, old = [], self.new, self.old
        for k in dict.fromkeys(keys):
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                new[k] = v
        return out


class PieceEncoder:
    """ids of a text as little-endian unsigned 32-bit integers.

    ``encode_words`` does so for matches of ``pattern``, which are encoded each alone.
    """

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], list[bytes]], keep_pieces: int = 200_000, keep_words: int = 50_000):
        # the pattern's white space is Unicode's property, whatever the library's \s is
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.encode_words = encode_words
        self.after_blank, self.words = Memo(keep_pieces), Memo(keep_words)

    def _all(self, pieces: list[str]) -> list[bytes]:
        find = self.find
        # a blank and letters, or letters alone, are one match, and a mark behind them is the next
        cut = [(p,) if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else (p[:-1], p[-1]) if p[-1:] in _MARKS and p[1:-1].isalpha() and (p[0] == " " or p[0].isalpha()) else find(p) for p in pieces]
        memo = self.words.room(2 * len(cut))
        new = self.words.missing([w for ws in cut for w in ws if w not in memo])
        if new:
            memo.update(zip(new, self.encode_words(new), strict=True))
        return [memo[ws[0]] if len(ws) == 1 else b"".join([memo[w] for w in ws]) for ws in cut]

    def _by_units(self, text: str) -> bytes:
        units = _UNIT.findall(text)
        return b"".join(x for at in range(0, len(units), 10_000) for x in self._all(units[at : at + 10_000]))

    def encode(self, text: str) -> bytes:
        if _ODD.search(text) or text[-1:] == " ":
            return self._by_units(text)
        first, *rest = text.split(" ")
        if not rest:
            return self._by_units(text)
        last = rest.pop()
        memo = self.after_blank.room(len(rest))
        parts = list(map(memo.get, rest))
        if None in parts:
            new = self.after_blank.missing([p for p, v in zip(rest, parts, strict=True) if v is None])
            for at in range(0, len(new), 4_000):
                run = new[at : at + 4_000]
                # a blank and letters are one match: nothing to cut, nothing to remember twice
                plain, others = [p for p in run if p.isalpha()], [p for p in run if not p.isalpha()]
                memo.update(zip(plain, self.encode_words([" " + p for p in plain]), strict=True))
                memo.update(zip(others, self._all([" " + p for p in others]), strict=True))
            parts = [memo[p] if v is None else v for p, v in zip(rest, parts, strict=True)]
        ends = self._all([first, " " + last])
        return b"".join([ends[0], *parts, ends[1]])
