"""Problem 1: occurrences and record counts of every term, name or n-gram.

Each task joins its records into blocks, sorts the block's suffixes (token
positions, compared up to max_n tokens and never across a record's end) and reads
the counts off the common-prefix intervals of that suffix array: an interval of
common prefix >= n holds exactly the occurrences of one n-gram. Records are counted
by the same array: an occurrence whose predecessor *of the same record* shares n
tokens is a duplicate adjacency, and records = occurrences - duplicate adjacencies.
Blocks hold whole records, so both counts add up over blocks; Spark sums the partial
counts map-side and then by n-gram. Records delivered twice are left out at their places, so
texts are not shuffled as long as such copies are few, and posting lists never are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.terms import as_string, term_array
from codelode.session import once_in_place

#: Bytes of text that make a block, of its n-th part where n-grams up to n are asked, since a token then takes so
#: much more memory; a longer record is a block of its own.
BLOCK_BYTES = 16 << 20

RARE_RECORDS, COMMON_SHARE_CONTENT, COMMON_SHARE_NAME = 3, 5, 200
_SCHEMA = "gram string, occurrences long, records long"


def suffix_intervals(codes: np.ndarray, record: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, a position of each distinct n-gram, occurrences, records) for n = 1..max_n.

    codes: token ids >= 0 in text order; record: the record of each, ascending.
    """
    if not len(codes):
        return
    ahead = [codes.astype(np.int32) + 1]  # 0 stands for "beyond the record"
    for d in range(1, max_n):
        col = np.zeros(len(codes), np.int32)
        if d < len(codes):
            same = record[d:] == record[:-d]
            col[:-d][same] = ahead[0][d:][same]
        ahead.append(col)
    order = np.argsort(ahead[0], kind="stable") if max_n == 1 else np.lexsort(ahead[::-1])

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, alive = np.zeros(len(a), np.int32), np.ones(len(a), bool)
        for col in ahead:
            alive &= (col[a] == col[b]) & (col[a] != 0)
            n += alive
        return n

    lcp = common(order[:-1], order[1:])
    by_record = np.argsort(record[order], kind="stable")  # a record's suffixes, still in suffix order
    a, b = by_record[:-1], by_record[1:]
    same = record[order[a]] == record[order[b]]
    a, b = a[same], b[same]
    again = common(order[a], order[b])
    for n in range(1, max_n + 1):
        interval = np.concatenate([[0], np.cumsum(lcp < n)])
        whole = ahead[n - 1][order] != 0
        count = np.bincount(interval[whole], minlength=interval[-1] + 1)
        twice = np.bincount(interval[b[again >= n]], minlength=interval[-1] + 1)
        head = np.concatenate([[0], np.flatnonzero(lcp < n) + 1])
        some = count > 0
        yield n, order[head[some]], count[some], (count - twice)[some]


def _block(texts: pa.Array, max_n: int, whole: bool) -> Iterator[pa.RecordBatch]:
    if whole:
        text = pc.utf8_trim(texts, characters=" \t\r\n")
        keep = np.flatnonzero(pc.greater(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False))
        terms, record = text.take(pa.array(keep)), keep
    else:
        terms, record = term_array(texts)
    if not len(terms):
        return
    coded = terms.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    for n, at, occurrences, records in suffix_intervals(codes, record, max_n):
        parts = [words.take(pa.array(codes[at + d])) for d in range(n)]
        grams = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [grams.cast(pa.string()), pa.array(occurrences.astype(np.int64)), pa.array(records.astype(np.int64))],
            ["gram", "occurrences", "records"],
        )


def _counter(max_n: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0
        for batch in batches:
            column = as_string(batch.column(0))
            held.append(column)
            size += column.nbytes
            if size * max_n >= BLOCK_BYTES:
                yield from _block(pa.concat_arrays(held), max_n, whole)
                held, size = [], 0
        if held:
            yield from _block(pa.concat_arrays(held), max_n, whole)

    return run


def ngram_frequencies(df: DataFrame, text: str, key: str = "id", max_n: int = 1, whole: bool = False) -> DataFrame:
    """(n, gram, occurrences, records) of every n-gram of up to max_n terms of a text column.

    A record is one key, however often delivered; a null key makes its row a record
    of its own. Null, empty and blank texts have no terms. whole: the whole text,
    without white space at its ends and in its own case, is the one token. Further
    columns, also named gram or n, don't matter. An empty table gives no rows.
    """
    records = once_in_place(df.select(F.col(key).alias("id"), F.col(text).alias("text")), "id")
    parts = records.select("text").mapInArrow(_counter(max_n, whole), _SCHEMA)
    counts = parts.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    # terms hold no blank, so an n-gram's n need not travel with it
    n = F.lit(1) if whole else F.length("gram") - F.length(F.replace("gram", F.lit(" "), F.lit(""))) + 1
    return counts.select(n.cast("int").alias("n"), "gram", "occurrences", "records")


def record_count(df: DataFrame, key: str = "id") -> int:
    """Distinct keys, and every row without one."""
    row = df.agg(F.count_distinct(F.col(key)).alias("n"), F.sum(F.col(key).isNull().cast("long")).alias("m")).first()
    return (row["n"] or 0) + (row["m"] or 0)


def marked_terms(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, records, mark) for every term of code_chunks.content and name of code_symbols.

    mark: `rare` for a term of fewer than 3 chunks or a name of one symbol; `common` for
    a term of more than a fifth of all chunks or a name of more than 1 in 200 symbols;
    null between. Where a table is so small that both hold, a row stands for each.
    """
    n_chunks, n_symbols = record_count(chunks), record_count(symbols)
    rare, common = F.lit("rare"), F.lit("common")

    def mark(df: DataFrame, field: str, is_rare: F.Column, is_common: F.Column) -> DataFrame:
        marks = F.filter(F.array(F.when(is_rare, rare), F.when(is_common, common)), lambda x: x.isNotNull())
        return df.select(F.lit(field).alias("field_name"), F.col("gram").alias("term"), "occurrences", "records", F.explode_outer(marks).alias("mark"))

    content = ngram_frequencies(chunks, "content")
    name = ngram_frequencies(symbols, "name", whole=True)
    return mark(content, "content", F.col("records") < RARE_RECORDS, F.col("records") * COMMON_SHARE_CONTENT > n_chunks).unionByName(
        mark(name, "name", F.col("records") == 1, F.col("records") * COMMON_SHARE_NAME > n_symbols)
    )
