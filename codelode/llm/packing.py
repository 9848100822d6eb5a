"""Problem 7: documents of varying length packed into containers of fixed capacity.

Bulk-synchronous best fit. What is to be placed (documents, and the parts of those that alone
exceed a capacity) and the gaps of the open containers are rows of one table, written anew
each round. A round

1. opens as many containers as what is left surely needs,
2. range-sorts pieces and gaps together by size, from large to small, across the cluster,
3. sweeps each partition: a gap is laid on a stack, a piece takes the gap on top, which is
   its successor, the narrowest one that holds it; a gap that holds several of the largest
   piece left counts as often,
4. resolves what meets across partitions by rank: unmatched pieces and gaps are numbered, and
   how many of which partition meet follows from two counts a partition,
5. narrows the gaps by what they took, and repeats with the pieces that found none.

As in sequential best fit the larger piece chooses first. Half the pieces or more go in each
of the first rounds, so the rounds grow with the logarithm of the pieces in a container.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.tokens import VOCABULARY, token_sizes
from codelode.session import discard, materialise, maybe_broadcast

PACKED = "spec_id int, capacity_tokens int, container long, doc_id long, part int, parts int, first_token long, tokens int"
#: A round's table: gaps and pieces.
_STATE = "spec_id int, kind int, size int, container long, doc_id long, part int, parts int, first_token long"
_GAP, _PIECE, _PLACED = 0, 1, 2
#: What a sweep gives: placed pieces, and by partition and rank the pieces and gaps left over.
_SWEPT = _STATE + ", place int, rank long, slots long"
_PIECE_COLUMNS = ["doc_id", "part", "parts", "first_token"]


def _pieces(specs: list[tuple[int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc, tokens = batch["doc_id"].to_numpy(), batch["tokens"].to_numpy()
            for spec, capacity in specs:
                parts = np.maximum((tokens + capacity - 1) // capacity, 1)
                row = np.repeat(np.arange(len(doc)), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                begin = part * capacity
                size = np.minimum(tokens[row] - begin, capacity)
                yield pd.DataFrame(
                    {"spec_id": np.int32(spec), "kind": np.int32(_PIECE), "size": size.astype(np.int32), "container": pd.array([None] * len(row), "Int64"), "doc_id": doc[row], "part": (part + 1).astype(np.int32), "parts": parts[row].astype(np.int32), "first_token": begin},
                    index=np.arange(len(row)),
                )

    return run


def _sweeper(largest: dict[int, int]):
    """The sweep of one sorted partition. largest: the largest piece left, by spec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        spec, stack, missed = None, [], 0  # stack: [container, width, how often it may still be taken]

        def left_over() -> list[tuple]:
            rows, rank = [], 0
            for container, width, slots in stack:
                rows.append((spec, _GAP, width, container, None, None, None, None, place, rank, slots))
                rank += slots
            return rows

        for batch in batches:
            rows: list[tuple] = []
            for this, kind, size, container, *piece in zip(*(column.to_pylist() for column in batch.columns)):
                if this != spec:
                    rows += left_over()
                    spec, stack, missed = this, [], 0
                if kind == _GAP:
                    stack.append([container, size, max(size // largest[this], 1)])
                elif stack:
                    top = stack[-1]
                    rows.append((this, _PLACED, size, top[0], *piece, place, None, None))
                    top[2] -= 1
                    if not top[2]:
                        stack.pop()
                else:
                    rows.append((this, _PIECE, size, None, *piece, place, missed, None))
                    missed += 1
            yield _batch(rows)
        yield _batch(left_over())

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in _SWEPT.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def meet_by_rank(counts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces and gaps left over in the partitions meet.

    counts: (spec, partition, pieces left, gaps left) in order of partitions; of a partition the
    pieces left come before its gaps. Returns (spec, partition of the pieces, first rank, partition of
    the gaps, rank of the last gap, how many): the i-th of those pieces takes the gap of rank last - i.
    There are at most two entries for each partition.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    spec, stack = None, []
    for this, place, pieces, gaps in counts:
        if this != spec:
            spec, stack = this, []
        first = 0
        while first < pieces and stack:
            where, held = stack[-1]
            n = min(pieces - first, held)
            out.append((spec, place, first, where, held - 1, n))
            first += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([place, gaps])
    return out


def _across(spark: SparkSession, swept: DataFrame) -> DataFrame:
    """The pieces left over in all partitions, those that meet a gap of another one with its container."""
    pieces, gaps = swept.filter(F.col("kind") == _PIECE), swept.filter(F.col("kind") == _GAP)
    tally = swept.filter(F.col("kind") != _PLACED).groupBy("spec_id", "place").agg(F.count_if(F.col("kind") == _PIECE).alias("pieces"), F.coalesce(F.sum("slots"), F.lit(0)).alias("gaps"))
    plan = meet_by_rank([tuple(r) for r in tally.orderBy("spec_id", "place").collect()])  # two numbers a partition and spec
    if not plan:
        return pieces
    met = maybe_broadcast(spark.createDataFrame([(*p, k) for k, p in enumerate(plan)], "m_spec int, m_place int, m_first long, m_where int, m_last long, m_count long, m_id int"))
    mine = (F.col("spec_id") == F.col("m_spec")) & (F.col("place") == F.col("m_place")) & (F.col("rank") >= F.col("m_first")) & (F.col("rank") < F.col("m_first") + F.col("m_count"))
    numbered = pieces.drop("container").join(met, mine, "left").withColumn("nth", F.col("rank") - F.col("m_first"))
    held = (F.col("spec_id") == F.col("m_spec")) & (F.col("place") == F.col("m_where")) & (F.col("rank") <= F.col("m_last")) & (F.col("rank") + F.col("slots") > F.col("m_last") - F.col("m_count") + 1)
    low = F.greatest(F.col("m_last") - F.col("rank") - F.col("slots") + 1, F.lit(0))
    high = F.least(F.col("m_last") - F.col("rank"), F.col("m_count") - 1)
    taken = gaps.join(met, held).select("m_id", "container", F.explode(F.sequence(low, high)).alias("nth"))
    return numbered.join(taken, ["m_id", "nth"], "left").select(*swept.columns)


#: Containers that one row of an opening stands for.
_BLOCK = 1 << 16


def _opened(spark: SparkSession, new: list[tuple[int, int, int, int]]) -> DataFrame:
    """Gaps of new containers from (spec, capacity, first container, how many)."""
    blocks = [(s, c, first + at, min(n - at, _BLOCK)) for s, c, first, n in new for at in range(0, n, _BLOCK)]
    rows = spark.createDataFrame(blocks, "spec_id int, size int, first long, n long").select("spec_id", "size", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("container"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("doc_id", "long"), ("part", "int"), ("parts", "int"), ("first_token", "long"))]
    return rows.select("spec_id", F.lit(_GAP).alias("kind"), "size", "container", *none)


def _openings(state: DataFrame, capacity: dict[int, int], used: dict[int, int]) -> tuple[list[tuple[int, int, int, int]], dict[int, int]]:
    """(containers to open, largest piece by spec). What is left needs a container for each capacity of
    tokens that the gaps can't take, and so do the pieces wider than any gap; no more are opened."""
    piece = F.col("kind") == _PIECE
    width, size = F.when(~piece, F.col("size")), F.when(piece, F.col("size"))
    known = state.groupBy("spec_id").agg(F.max(width).alias("widest"), F.sum(width).alias("open"), F.max(size).alias("largest"), F.sum(size).alias("left")).filter("largest is not null").collect()  # a row a spec
    wider = [piece & (F.col("spec_id") == r["spec_id"]) & (F.col("size") > (r["widest"] or 0)) for r in known if r["largest"] > (r["widest"] or 0)]
    stuck = {}
    if wider:
        rows = state.filter(reduce(lambda a, b: a | b, wider)).groupBy("spec_id").agg(F.sum("size").alias("stuck")).collect()
        stuck = {r["spec_id"]: int(r["stuck"]) for r in rows}
    new, largest = [], {}
    for r in known:
        spec = r["spec_id"]
        largest[spec] = int(r["largest"])
        n = max(-(-(r["left"] - (r["open"] or 0)) // capacity[spec]), -(-stuck.get(spec, 0) // capacity[spec]), 0)
        if n:
            new.append((spec, capacity[spec], used[spec], n))
            used[spec] += n
    return new, largest


def pack_sizes(sizes: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """PACKED rows for documents given as (doc_id, tokens) and (spec_id, capacity) pairs."""
    capacity = {int(s): int(c) for s, c in specs if s is not None and c is not None and c > 0}
    spark = sizes.sparkSession
    if not capacity:
        return spark.createDataFrame([], PACKED)
    some = sizes.filter((F.col("tokens") > 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("long").alias("tokens"))
    state = materialise(some.mapInPandas(_pieces(sorted(capacity.items())), _STATE), "p7-pieces")
    used = dict.fromkeys(capacity, 0)
    order = [F.col("spec_id"), F.desc("size"), F.col("kind"), F.col("doc_id"), F.col("part"), F.col("container")]
    placed: list[DataFrame] = []
    while True:
        new, largest = _openings(state, capacity, used)
        if not largest:
            break
        live = state.filter(F.col("spec_id").isin(*largest))  # the other specs are done
        entries = live.unionByName(_opened(spark, new)) if new else live
        ranged = entries.select(*[f.split()[0] for f in _STATE.split(", ")]).repartitionByRange(*order).sortWithinPartitions(*order)
        swept = materialise(ranged.mapInArrow(_sweeper(largest), _SWEPT), "p7-swept")
        crossed = _across(spark, swept)
        columns = ["spec_id", "size", "container", *_PIECE_COLUMNS]
        now = materialise(swept.filter(F.col("kind") == _PLACED).select(*columns).unionByName(crossed.select(*columns)), "p7-placed")
        placed.append(now.filter("container is not null"))
        # a container is named once as gap and once for every piece it took
        widths = entries.filter(F.col("kind") == _GAP).select("spec_id", "container", "size").unionByName(placed[-1].select("spec_id", "container", (-F.col("size")).alias("size")))
        gaps = widths.groupBy("spec_id", "container").agg(F.sum("size").cast("int").alias("size")).filter("size > 0")
        none = [F.lit(None).cast(t).alias(n) for n, t in (("doc_id", "long"), ("part", "int"), ("parts", "int"), ("first_token", "long"))]
        after = gaps.select("spec_id", F.lit(_GAP).alias("kind"), "size", "container", *none).unionByName(now.filter("container is null").select("spec_id", F.lit(_PIECE).alias("kind"), "size", "container", *_PIECE_COLUMNS))
        before, state = state, materialise(after, "p7-state")
        discard(before, swept)
    whole = placed[0] if placed else spark.createDataFrame([], "spec_id int, size int, container long, doc_id long, part int, parts int, first_token long")
    for part in placed[1:]:
        whole = whole.unionByName(part)
    capacities = F.create_map(*[F.lit(x) for pair in capacity.items() for x in pair])
    return whole.select("spec_id", F.element_at(capacities, F.col("spec_id")).alias("capacity_tokens"), "container", *_PIECE_COLUMNS, F.col("size").alias("tokens"))


def pack_documents(documents: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_id, capacity_tokens, container, doc_id, part, parts, first_token, tokens), containers from 0 for each spec.

    A text is one piece unless it alone exceeds the capacity; then it comes in parts of the
    capacity and a rest. Null and empty texts have no tokens and no row, nor have rows without
    doc_id; a doc_id that occurs twice is packed twice. Specs without a positive capacity give
    nothing; of a spec_id with several capacities the largest counts.
    """
    asked = specs.groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity_tokens")).orderBy("spec_id").collect()  # a row a container size
    return pack_sizes(token_sizes(documents, ("doc_id",), vocabulary), [tuple(r) for r in asked])


def container_fill(packed: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, containers, pieces, tokens, fill): how full the containers are."""
    by_container = packed.groupBy("spec_id", "capacity_tokens", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    total = by_container.groupBy("spec_id", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def packing_checks(packed: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, documents, overfull, torn, lost): what must hold of a packing.

    overfull: containers above the capacity; torn: documents divided though they fit; lost: documents
    whose parts don't follow on one another from the first token.
    """
    keys = ["spec_id", "capacity_tokens"]
    full = packed.groupBy(*keys, "container").agg(F.sum("tokens").alias("tokens")).groupBy(*keys).agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"))
    docs = packed.groupBy(*keys, "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.max("parts").alias("parts"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    torn = (F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))
    lost = (F.col("pieces") != F.col("parts")) | (F.col("end") != F.col("tokens"))
    return docs.groupBy(*keys).agg(F.count("*").alias("documents"), F.count_if(torn).alias("torn"), F.count_if(lost).alias("lost")).join(full, keys).select(*keys, "documents", "overfull", "torn", "lost")
