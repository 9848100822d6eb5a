"""Postings of whole blocks of documents: made where the documents are read, and scored a block at a time.

A block is at most 65,536 documents of one partition, numbered by their ids' order. It has a row without a
term, which holds its ids and lengths, and a row a term: docs are the numbers (uint16) of the documents that
hold it, tfs how often (uint8, or int32 where one is above 255).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from codelode.functions.text import STOPWORDS, TOKEN_MAX, TOKEN_MIN

SCHEMA = "block long, term string, df int, docs binary, tfs binary, ids array<string>, dls array<int>"
_ARROW = pa.schema([("block", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("docs", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(pa.string())), ("dls", pa.list_(pa.int32()))])
#: A block ends when it holds so many documents or (document, term) pairs. Batches are cut before, to about SLICE documents or SLICE_BYTES.
BLOCK_DOCS, BLOCK_PAIRS, SLICE, SLICE_BYTES = 24576, 4_000_000, 4096, 8 << 20
#: Words whose terms a worker remembers between blocks.
MOST_WORDS = 400_000

_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]*|\d+")
_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|\d+")
_STOP = frozenset(STOPWORDS)


def _stem(t: str) -> str:
    if t.endswith("ss"):
        return t
    for least, suffix, cut, more in ((4, "ies", 3, "y"), (5, "sses", 2, ""), (5, "ing", 3, ""), (5, "ed", 2, ""), (4, "es", 2, ""), (3, "s", 1, "")):
        if len(t) > least and t.endswith(suffix):
            return t[:-cut] + more
    return t


def word_terms(word: str) -> list[str]:
    """The terms of one word, as text.tokens has them."""
    if len(word) > TOKEN_MAX:
        return []
    low = word.lower()
    parts = [word] if word == low and "_" not in word else [p.lower() for p in _PART.findall(word)]
    if len(parts) > 1:
        parts.append(low.replace("_", ""))
    return [_stem(p) for p in parts if TOKEN_MIN <= len(p) <= TOKEN_MAX and p not in _STOP]


class _Words(dict):
    """Numbers of words; a word met first gets its terms."""

    def __init__(self):
        self.terms: dict[str, int] = {}
        self.flat, self.size = array("q"), array("q")

    def __missing__(self, word: str) -> int:
        of = word_terms(word)
        self.flat.extend(self.terms.setdefault(t, len(self.terms)) for t in of)
        self.size.append(len(of))
        self[word] = n = len(self)
        return n

    def occurrences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(places of texts, numbers of terms): a pair a token."""
        listed = [_WORD.findall(t) if t else [] for t in texts]
        words = np.fromiter((n for ws in listed for n in map(self.__getitem__, ws)), np.int64)
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, listed), np.int64, len(texts)))
        size = np.array(self.size, np.int64)
        first = np.cumsum(size) - size
        term = np.array(self.flat, np.int64)[_spans(first[words], size[words])]
        return np.repeat(doc, size[words]), term


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (size[i] of them) for each i."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class _Block:
    def __init__(self, words: _Words):
        self.words, self.ids, self.lengths, self.keys, self.counts, self.pairs = words, [], [], [], [], 0

    def add(self, ids: list, texts: list) -> None:
        doc, term = self.words.occurrences(texts)
        self.lengths.append(np.bincount(doc, minlength=len(ids)))
        keys, counts = np.unique((term << 32) | (doc + len(self.ids)), return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int32))
        self.ids += ids
        self.pairs += len(keys)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or ""))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.concatenate(self.lengths)[order]
        yield _batch([pa.array([block]), pa.array([None]), pa.array([None]), pa.array([None]), pa.array([None]), pa.array([[self.ids[i] for i in order]], pa.list_(pa.string())), pa.array([lengths.tolist()], pa.list_(pa.int32()))])
        keys, tf = np.concatenate(self.keys), np.concatenate(self.counts)
        if not len(keys):
            return
        held, at = np.unique(keys >> 32, return_inverse=True)
        names = list(self.words.terms)
        names = [names[c] for c in held]
        by_name = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        keys = (rank[at] << 32) | place[keys & 0xFFFFFFFF]
        sort = np.argsort(keys)
        keys, tf = keys[sort], tf[sort]
        df = np.bincount(keys >> 32, minlength=len(names))
        wide = np.maximum.reduceat(tf, np.cumsum(df) - df) > 255
        none = pa.nulls(len(names))
        yield _batch([pa.array(np.full(len(names), block)), pa.array([names[i] for i in by_name]), pa.array(df), _binary((keys & 0xFFFF).astype("<u2"), df), _frequencies(tf, df, wide), none, none])


def _binary(values: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _frequencies(tf: np.ndarray, df: np.ndarray, wide: np.ndarray) -> pa.Array:
    if not wide.any():
        return _binary(tf.astype(np.uint8), df)
    return pa.array([x.astype("<i4" if w else np.uint8).tobytes() for x, w in zip(np.split(tf, np.cumsum(df)[:-1]), wide)], pa.binary())


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, min(SLICE, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
    return (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def embedder(size: int = 256) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, embedding) of (doc_id, text) batches: paths.hashing_embedding of the tokens, a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes = _Words(), array("q")
        for batch in batches:
            for part in slices(batch):
                doc, term = words.occurrences(part.column(1).to_pylist())
                for t in islice(words.terms, len(codes), None):
                    d = hashlib.blake2b(t.encode(), digest_size=8).digest()
                    codes.append(2 * (int.from_bytes(d[:4], "big") % size) + (d[4] & 1))
                code = np.array(codes, np.int64)[term]
                v = np.bincount(doc * size + (code >> 1), 2.0 * (code & 1) - 1, part.num_rows * size).reshape(-1, size)
                norm = np.array([max(x**0.5, 1e-12) for x in (v * v).sum(1).tolist()])
                flat = pa.array((v / norm[:, None]).ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * size, flat)], ["doc_id", "embedding"])
                if len(words) > MOST_WORDS:
                    words, codes = _Words(), array("q")

    return run


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA of (id, text) batches."""
    words = _Words()
    block, n = _Block(words), TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch):
            block.add(part.column(0).to_pylist(), part.column(1).to_pylist())
            if len(block.ids) >= BLOCK_DOCS or block.pairs >= BLOCK_PAIRS:
                yield from block.rows(n)
                words = words if len(words) < MOST_WORDS else _Words()
                block, n = _Block(words), n + 1
    if block.ids:
        yield from block.rows(n)


class Best:
    """The k best documents of each of n queries over what a task reads, by score of six digits and id."""

    def __init__(self, names: pa.Array, k: int):
        self.names, self.k = names, k
        self.top, self.low = np.full((len(names), k), -np.inf), np.full(len(names), -np.inf)  # the best scores so far, and the least of them
        self.ids, self.documents = [], 0
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, 2 * len(names) * k + (1 << 20)

    def add(self, ids: pa.Array, found: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """(query, places in ids, scores) of documents, ids in order; those below a query's `low` less 1e-6 may be left out."""
        asked, places, scores = [], [], []
        for q, place, score in found:
            place, score = best(place, np.round(score, 6), self.k)
            keep = score >= self.low[q]
            place, score = place[keep], score[keep]
            if len(score):
                self.top[q] = np.partition(np.concatenate([self.top[q], score]), len(score))[len(score) :]
                self.low[q] = self.top[q].min()
                asked.append(np.full(len(place), q, np.int32))
                places.append(place + self.documents)
                scores.append(score)
        if not asked:
            return
        self.rows.append((np.concatenate(asked), np.concatenate(places), np.concatenate(scores)))
        self.ids.append(ids)
        self.documents += len(ids)
        self.size += len(self.rows[-1][0])
        if self.size > self.most or self.documents > self.most:
            self._shorten()

    def _shorten(self) -> None:
        asked, places, scores = (np.concatenate(x) for x in zip(*self.rows))
        keep = scores >= self.low[asked]
        asked, scores = asked[keep], scores[keep]
        held, places = np.unique(places[keep], return_inverse=True)
        ids = pa.concat_arrays(self.ids).take(pa.array(held))
        order = pc.sort_indices(ids, null_placement="at_start")
        rank = np.empty(len(ids), np.int64)
        rank[order.to_numpy()] = np.arange(len(ids))
        sort = np.lexsort((rank[places], -scores, asked))
        asked, places, scores = asked[sort], rank[places][sort], scores[sort]
        first = np.flatnonzero(np.diff(asked, prepend=-1))
        keep = np.arange(len(asked)) - np.repeat(first, np.diff(first, append=len(asked))) < self.k
        self.ids, self.documents = [ids.take(order)], len(ids)
        self.rows, self.size = [(asked[keep], places[keep], scores[keep])], int(keep.sum())

    def batches(self, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """(query_id, doc_id, score)."""
        if not self.rows:
            return
        self._shorten()
        (asked, places, scores), ids = self.rows[0], self.ids[0]
        for at in range(0, len(asked), step):
            some = slice(at, at + step)
            yield pa.RecordBatch.from_arrays([self.names.take(pa.array(asked[some])), ids.take(pa.array(places[some])), pa.array(scores[some])], ["query_id", "doc_id", "score"])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from batches in order of blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.column(0).to_numpy()
        for a, z in pairwise([0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), len(n)] if len(n) else []):
            if held and held[0].column(0)[0].as_py() != n[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def scorer(asked: list[tuple[object, list[tuple[str, float]]]], kind: pa.DataType, k: int, k1: float, b: float, average: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows in order of blocks the task's k best documents of each (query, its terms with their weights), by BM25 of six digits and id."""

    def block(rows: pa.Table, held: Best) -> None:
        terms, docs, tfs = (rows.column(c).to_pylist() for c in ("term", "docs", "tfs"))
        head = terms.index(None)
        ids, lengths = rows.column("ids")[head].values, np.array(rows.column("dls")[head].as_py(), np.float64)
        at = {t: i for i, t in enumerate(terms) if t is not None}
        norm = k1 * (1 - b + b * lengths / average)
        parts: dict[tuple[str, float], tuple[np.ndarray | None, np.ndarray]] = {}
        total, found = np.zeros(len(norm)), []
        for q, (_, weights) in enumerate(asked):
            hit = []
            for term in weights:
                if term[0] not in at:
                    continue
                if term not in parts:
                    i = at[term[0]]
                    doc = np.frombuffer(docs[i], "<u2")
                    tf = np.frombuffer(tfs[i], np.uint8 if len(tfs[i]) == len(doc) else "<i4").astype(np.float64)
                    part = term[1] * tf * (k1 + 1) / (tf + norm[doc])
                    if len(doc) * 8 > len(norm):  # frequent ones are added as a whole
                        every = np.zeros(len(norm))
                        every[doc] = part
                        doc, part = None, every
                    parts[term] = doc, part
                hit.append(parts[term])
            if not hit:
                continue
            low = max(held.low[q], 0.0) - 1e-6
            if all(doc is not None for doc, _ in hit) and sum(len(doc) for doc, _ in hit) * 8 < len(norm):
                for doc, part in hit:
                    total[doc] += part
                some = np.unique(np.concatenate([doc for doc, _ in hit])) if len(hit) > 1 else hit[0][0].astype(np.int64)
                score = total[some]
                total[some] = 0
                some, score = some[score >= low], score[score >= low]
            else:
                for doc, part in hit:
                    if doc is None:
                        total += part
                    else:
                        total[doc] += part
                some = np.flatnonzero(total >= low) if low > 0 else np.flatnonzero(total)
                score = total[some]
                total.fill(0)
            some, score = best(some.astype(np.int64), np.round(score, 6), k)
            found.append((q, some[score > 0], score[score > 0]))
        held.add(ids, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Best(pa.array([q for q, _ in asked], kind), k)
        for rows in _by_block(batches):
            block(rows, held)
        yield from held.batches()

    return run


def best(places: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of the highest score; of equal ones those that stand first."""
    if len(score) <= k:
        return places, score
    edge = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > edge)
    keep = np.concatenate([above, np.flatnonzero(score == edge)[: k - len(above)]])
    return places[keep], score[keep]
