"""Trigram index over a block of texts, and the trigrams that a regular expression requires."""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from re import _constants as sre
from re import _parser as parser

from codelode.llm.terms import text_bytes

_MOST = 256
_SLICE = 8 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Query = tuple | str | bool


def _all(parts: list[Query]) -> Query:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[Query]) -> Query:
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> Query:
    """Some one of the strings occurs."""
    return _any([_all(sorted({s[i : i + 3] for i in range(len(s) - 2)})) if len(s) > 2 else True for s in sorted(strings)]) if strings else True


def _members(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, av in items:
        if op is sre.LITERAL:
            out.add(chr(av).lower())
        elif op is sre.RANGE and av[1] - av[0] < 8:
            out |= {chr(c).lower() for c in range(av[0], av[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(items) -> tuple[set[str] | None, Query]:
    """(the exact strings the items match or None, what any match requires)."""
    found: list[Query] = []
    run: set[str] = {""}
    exact = True

    def flush() -> None:
        nonlocal run
        found.append(_of_strings(run))
        run = {""}

    for op, av in items:
        strings: set[str] | None = None
        need: Query = True
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if op is sre.LITERAL:
            strings = {chr(av).lower()}
        elif op is sre.IN:
            strings = _members(av)
        elif op is sre.SUBPATTERN:
            strings, need = _walk(av[3])
        elif op is sre.BRANCH:
            branches = [_walk(b) for b in av[1]]
            if all(s is not None for s, _ in branches):
                strings = set().union(*(s for s, _ in branches))
            need = _any([q for _, q in branches])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, sub = av
            inner, q = _walk(sub)
            if low == high and low <= 8 and inner is not None and len(inner) ** low <= _MOST:
                strings = {"".join(x) for x in product(inner, repeat=low)}
            elif (low, high) == (0, 1) and inner is not None:
                strings = {""} | inner
            elif low:
                need = q
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        flush()
        if strings is not None:
            run = strings
        else:
            found.append(need)
    if exact:
        return run, _of_strings(run)
    flush()
    return None, _all(found)


def required(pattern: str) -> Query:
    """What lower-cased trigrams any match of the pattern holds, as nested and / or."""
    return _walk(parser.parse(pattern, re.IGNORECASE))[1]


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1:]))


class BlockIndex:
    """Postings of the wanted trigrams over one block of texts, as a bitmap for each."""

    def __init__(self, wanted: list[str]):
        self.number = {t: k for k, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, k in self.number.items():
            a, b, c = t.encode("ascii")
            self.table[a << 16 | b << 8 | c] = k + 1
        self.bits = np.zeros((len(wanted), 0), bool)

    def build(self, texts: pa.Array) -> None:
        raw, at = text_bytes(texts)
        self.bits = np.zeros((len(self.number), len(texts)), bool)
        for begin in range(0, max(len(raw) - 2, 0), _SLICE):
            low = _LOWER[raw[begin : begin + _SLICE + 2]].astype(np.int32)
            ids = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            hit = np.flatnonzero(ids)
            doc = np.searchsorted(at, hit + begin, side="right") - 1
            inside = hit + begin + 2 < at[doc + 1]
            self.bits[ids[hit[inside]] - 1, doc[inside]] = True

    def candidates(self, query: Query) -> np.ndarray:
        """Whether each text of the block satisfies the query: postings intersected and united."""
        if query is True:
            return np.ones(self.bits.shape[1], bool)
        if isinstance(query, str):
            return self.bits[self.number[query]]
        sets = [self.candidates(q) for q in query[1:]]
        return np.logical_and.reduce(sets) if query[0] == "and" else np.logical_or.reduce(sets)
