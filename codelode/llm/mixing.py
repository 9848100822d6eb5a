"""Problem 8: records of several sources combined to target shares of all tokens.

The total is the largest at which every source reaches its share within its cap; a
source's records then have the same expected number of copies. The fractions are rounded
by pivotal dependent rounding: two fractional records exchange token mass, at random but
without changing either's expectation, until one of them is integral, so a source's tokens
stay what they were. Records meet from large to small, so partners are alike; a record more
than LONELY times as large as the next exchanges with all smaller ones of its node at once.
Each task rounds its own records so and leaves the smallest ones and the residual fractional;
these meet in a reduction tree of fixed fan-in, and at its root all are settled but one for
each source, which a last draw settles there. A source misses its share by less than that
record. Nothing but one row a source, the stock, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.tokens import VOCABULARY, token_sizes
from codelode.session import materialise

FAN_IN, LONELY, SEED = 32, 2, 20240501
#: A node hands on its smallest records: as many as weigh RESERVE times the source's largest one, at most RESERVE_ROWS.
RESERVE, RESERVE_ROWS = 4, 2048
_ROW = "doc_id long, source string, tokens long, copies int, fraction double, node long"
_NEAR = 1e-9


def _draw(*key) -> float:
    """A number in [0, 1) that the key fixes, so a task run again decides alike."""
    return xxhash.xxh3_64_intdigest("|".join(map(str, key))) / 2.0**64


def _exchange(rows: np.ndarray, a: int, partners: slice, seed: int, names: tuple) -> None:
    """Move mass between record a and its partners until a or one of them is integral; rows: (tokens, fraction).

    Partners' fractions move alike. The two ways have odds that keep every expectation.
    """
    tokens, p = rows[:, 0], rows[:, 1]
    open_ = (p[partners] > _NEAR) & (p[partners] < 1 - _NEAR)
    mass = float((tokens[partners] * open_).sum())
    if not mass:
        return
    others = p[partners][open_]
    up = min((1 - p[a]) * tokens[a], others.min() * mass)  # the most that a can gain
    down = min(p[a] * tokens[a], (1 - others.max()) * mass)  # and lose
    move = up if _draw(seed, *names) * (up + down) < down else -down
    p[a] += move / tokens[a]
    p[partners] -= np.where(open_, move / mass, 0.0)


def pivot(records: list[tuple[int, int, int, float]], keep: int, seed: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """Round (doc_id, tokens, whole copies, fraction) records of one source, but for the last `keep`, given from large to small.

    Returns the settled (doc_id, tokens, copies) and the records still fractional: of those to be
    rounded one at most. The sum of tokens times copies and fractions stays.
    """
    rows = np.array([(t, f) for _, t, _, f in records], np.float64).reshape(-1, 2)
    fraction = rows[:, 1]
    cut, now = len(records) - keep, None
    for k in range(cut):
        # a lonely record exchanges until it is integral, or everything smaller is
        while now is not None and _fractional(fraction[now]) and rows[now, 0] > LONELY * rows[k, 0] and _fractional(fraction[k:]).any():
            _exchange(rows, now, slice(k, None), seed, ("all", records[now][0], float(fraction[now])))
        if now is None or not _fractional(fraction[now]):
            now = k if _fractional(fraction[k]) else None
            continue
        if _fractional(fraction[k]):
            _exchange(rows, now, slice(k, k + 1), seed, (records[now][0], records[k][0]))
            now = now if _fractional(fraction[now]) else k if _fractional(fraction[k]) else None
    while keep and now is not None and _fractional(fraction[now]) and _fractional(fraction[cut:]).any() and rows[now, 0] > LONELY * rows[cut, 0]:
        _exchange(rows, now, slice(cut, None), seed, ("all", records[now][0], float(fraction[now])))
    settled, left = [], []
    for (doc, tokens, whole, _), p in zip(records, fraction.tolist()):
        if _fractional(p) and tokens:
            left.append((doc, tokens, whole, p))
        else:
            settled.append((doc, tokens, whole + (p > 0.5)))
    return settled, left


def _fractional(p):
    return (p > _NEAR) & (p < 1 - _NEAR)


_COLUMNS = ["doc_id", "source", "tokens", "copies", "fraction", "node"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"fraction": "float64", "node": "Int64"})


def _settle(records: list[tuple[int, int, int, float]], seed: int, largest: int | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """Round all but the smallest records; what is still fractional comes back. largest None: round all, the last by a draw."""
    records = sorted(records, key=lambda r: (-r[1], r[0]))
    if largest is None:
        settled, left = pivot(records, 0, seed)
        return settled + [(d, t, w + int(_draw(seed, "last", d) < p)) for d, t, w, p in left], []
    weight = np.cumsum([t for _, t, _, _ in reversed(records)])
    return pivot(records, min(int(np.searchsorted(weight, RESERVE * largest, side="right")), RESERVE_ROWS), seed)


def _round_task(expected: dict[str, float], largest: dict[str, int], seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict[str, list[tuple[int, int, int, float]]] = {}
        node = 0
        for batch in batches:
            rows = []
            for source, group in batch.groupby("source", sort=True):
                c = expected[source]
                whole, p = int(c + _NEAR), max(c - int(c + _NEAR), 0.0)
                records = [(d, t, whole, p) for d, t in zip(group["doc_id"].tolist(), group["tokens"].tolist())]
                settled, left[source] = _settle(left.get(source, []) + records, seed, largest[source])
                rows += [(d, source, t, w, None, None) for d, t, w in settled]
                node = int(group["place"].iloc[0]) >> 33  # the task's own number
            yield _frame(rows)
        yield _frame([(d, source, t, w, p, node) for source, some in left.items() for d, t, w, p in some])

    return run


def _round_group(largest: dict[str, int] | None, seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        records = list(zip(group["doc_id"].tolist(), group["tokens"].tolist(), group["copies"].tolist(), group["fraction"].tolist()))
        source, node = group["source"].iloc[0], int(group["parent"].iloc[0])
        settled, left = _settle(records, seed, largest and largest[source])
        return _frame([(d, source, t, w, None, None) for d, t, w in settled] + [(d, source, t, w, p, node) for d, t, w, p in left])

    return run


def plan_mixture(available: dict[str, int], targets: list[tuple[str, float, int]]) -> tuple[float, dict[str, float]]:
    """(tokens of the mixture, expected copies of each record by source).

    targets: (source, share, most copies). A source without tokens, share or copies takes no
    part and the others' shares are in proportion.
    """
    live = [(s, w, m) for s, w, m in targets if w > 0 and m > 0 and available.get(s, 0) > 0]
    if not live:
        return 0.0, {}
    whole = sum(w for _, w, _ in live)
    total = min(m * available[s] * whole / w for s, w, m in live)
    return total, {s: min(total * w / whole / available[s], float(m)) for s, w, m in live}


def _targets(mix_targets: DataFrame) -> list[tuple[str, float, int]]:
    """Targets by normal source; a source named twice counts with both shares and the lower cap."""
    rows = mix_targets.filter("source is not null").groupBy(_normal("source").alias("source")).agg(F.sum("target_share").alias("w"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("m"))
    return [(r["source"], float(r["w"] or 0.0), int(r["m"])) for r in rows.orderBy("source").collect()]


def _normal(source: str) -> F.Column:
    return F.lower(F.trim(F.col(source)))


def _sized(documents: DataFrame, names: list[str], vocabulary: str) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _normal("source").alias("source"), "text").filter(F.col("source").isin(*names) & F.col("doc_id").isNotNull())
    sized = token_sizes(rows, ("doc_id", "source"), vocabulary)
    return materialise(sized.withColumn("place", F.monotonically_increasing_id()), "p8-sizes")


def mix_sources(documents: DataFrame, mix_targets: DataFrame, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, copies) of every record the mixture holds, copies at least 1.

    Sources count without case and outer spaces. Records whose source is null or no target,
    and those without doc_id or without tokens, don't occur.
    """
    return _mix(documents, mix_targets, seed, vocabulary)[0]


def _mix(documents: DataFrame, mix_targets: DataFrame, seed: int, vocabulary: str) -> tuple[DataFrame, DataFrame, list[tuple[str, float, int]]]:
    targets = _targets(mix_targets)
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "doc_id long, source string, tokens long, copies int")
    if not targets:
        return empty, spark.createDataFrame([], "source string, records long, available_tokens long"), targets
    sized = _sized(documents, [s for s, _, _ in targets], vocabulary)
    stock = sized.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("available_tokens"), F.max("tokens").alias("largest"))
    have = {r["source"]: r for r in stock.collect()}  # one row for each target at most
    stock = stock.drop("largest")
    _, expected = plan_mixture({s: int(r["available_tokens"] or 0) for s, r in have.items()}, targets)
    if not expected:
        return empty, stock, targets
    largest = {s: int(have[s]["largest"]) for s in expected}
    usable = sized.filter(F.col("source").isin(*expected) & (F.col("tokens") > 0))
    rounded = materialise(usable.mapInPandas(_round_task(expected, largest, seed), _ROW), "p8-rounded")
    done = [rounded.filter("fraction is null")]
    open_ = rounded.filter("fraction is not null")
    level, root = 0, False
    while not root:
        state = open_.agg(F.count_distinct("source", "node").alias("nodes"), F.count_distinct("source").alias("sources"), F.count_distinct("node").alias("width")).first()
        root = state["nodes"] <= state["sources"] or state["width"] <= FAN_IN
        level += 1
        grouped = open_.withColumn("parent", F.lit(0) if root else F.floor(F.col("node") / FAN_IN)).groupBy("source", "parent").applyInPandas(_round_group(None if root else largest, seed + level), _ROW)
        step = materialise(grouped, "p8-tree")
        done.append(step.filter("fraction is null"))
        open_ = step.filter("fraction is not null")
    out = done[0].select("doc_id", "source", "tokens", "copies")
    for part in done[1:]:
        out = out.unionByName(part.select("doc_id", "source", "tokens", "copies"))
    return out.filter("copies > 0"), stock, targets


def mixture_shares(documents: DataFrame, mix_targets: DataFrame, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, target_share, max_repeats, records, available_tokens, used_records, copies, tokens, share, most_copies, largest) of every target.

    largest: tokens of the largest record used, by less than which the source misses its share.
    """
    mixed, stock, targets = _mix(documents, mix_targets, seed, vocabulary)
    spark = documents.sparkSession
    asked = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    used = mixed.groupBy("source").agg(F.count("*").alias("used_records"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"), F.max("copies").alias("most_copies"), F.max("tokens").alias("largest"))
    total = used.agg(F.sum("used_tokens")).first()[0] or 0
    rows = asked.join(stock, "source", "left").join(used, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(
        "source", "target_share", "max_repeats", zero("records"), zero("available_tokens"), zero("used_records"), zero("copies"),
        F.coalesce("used_tokens", F.lit(0)).cast("long").alias("tokens"),
        F.round(F.coalesce(F.col("used_tokens"), F.lit(0)) / F.lit(float(max(total, 1))), 6).alias("share"),
        zero("most_copies"), zero("largest"),
    )
