"""Problem 5: chunks whose content is mostly the same, over sets of term triples.

A fragment-wise set similarity join in the global order of triples, from rare to frequent.

1. Texts become sets once; these are written out and every later step reads them. Chunks
   with equal sets form classes, so copies are joined once.
2. Triples that no other class holds can't be shared. Every class posts its triples; what
   comes back is how many are shared, and a class with more unshared triples than a partner
   could lack is out. A sketch of bucket counts tells beforehand which triples are so frequent
   that a group of them would not fit well into a shuffle partition: these count as shared
   without being posted.
3. For the classes left, document frequencies are exact. The global order is cut vertically
   into fragments at pivots, and every set into its segments. A set takes part in the
   fragments that its prefix reaches (the rarest n - ceil(t n) + 1 triples, one of which any
   two similar sets share). In each fragment the segments meet on their triples, so candidates
   come out of the fragments with the overlap of each fragment counted, and the counts are
   summed per pair. A triple of many classes is split by salt.
4. A pair's fragments beyond the shorter prefix are counted only where the counts so far,
   with all that the other segments could share, still reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.terms import as_string, term_array
from codelode.session import discard, materialise, partitions

#: Least similarity as a fraction, least number of distinct triples.
SIMILAR, WHOLE, LEAST = 7, 10, 30
#: Fragments of the global order; times the mean from which a bucket of the sketch is hot.
FRAGMENTS, HOT = 8, 8
#: The sketch has 2 ** SKETCH_BITS buckets at least, and SPREAD of them for each shuffle partition, so that the
#: triples below a hot bucket's are a part of a partition at any size of the data; 2 ** SKETCH_MOST bounds its memory.
SKETCH_BITS, SPREAD, SKETCH_MOST = 16, 8, 22
#: Share of the hash range whose triples are posted in step 2. Unposted triples count as
#: shared, so any share keeps every link; a lower one shuffles less and prunes less.
POSTED = 0.5
#: Classes of a triple that one task joins with the others; more are split by salt.
SALT = 1024

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S30, _S27, _S31, _S45 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(45)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _S27)) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> _S31)


def triple_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(record, triple) of every distinct triple of every text, by record and triple."""
    terms, record = term_array(texts)
    if len(terms) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    coded = terms.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy(zero_copy_only=False)]
    whole = record[2:] == record[:-2]
    with np.errstate(over="ignore"):
        triple = _finish(h[:-2] * _M1 + ((h[1:-1] << _S31) | (h[1:-1] >> np.uint64(33))) * _M2 + ((h[2:] << _S45) | (h[2:] >> np.uint64(19))) * _M3)[whole]
    of = record[:-2][whole]
    order = np.lexsort((triple, of))
    of, triple = of[order], triple[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (triple[1:] != triple[:-1])
    return of[new], triple[new]


def _large(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record of each set, its first place, its size, triples) for sets of at least `least` triples."""
    of, triple = triple_sets(texts)
    size = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
    keep = size[of] >= least if len(of) else np.zeros(0, bool)
    sets = np.flatnonzero(size >= least)
    n = size[sets]
    return sets, np.cumsum(n) - n, n, triple[keep]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keys(triple: np.ndarray, head: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: two unlike sets share it once in 2 ** 64."""
    if not len(head):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return _finish(np.add.reduceat(_finish(triple + _M2), head) * _M1 + np.add.reduceat(_finish(triple ^ _M3), head))


def _setter(least: int):
    """Rows (id, k, n, triples): the set of each text by name and size; triples is null for a set seen before in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets, head, n, triple = _large(as_string(batch.column(1)), least)
            keys = _keys(triple, head)
            fresh = np.zeros(len(keys), bool)
            for i, k in enumerate(keys.tolist()):
                if k not in seen:
                    seen.add(k)
                    fresh[i] = True
            offsets = np.concatenate([[0], np.cumsum(np.where(fresh, n, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), _signed(triple[np.repeat(fresh, n)]), mask=pa.array(~fresh))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sets)).cast(pa.string()), _signed(keys), pa.array(n.astype(np.int32)), lists], ["id", "k", "n", "triples"])

    return run


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all triples one after another, how many each row has)."""
    size = np.nan_to_num(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), size


def _bucket(triple: np.ndarray, bits: int) -> np.ndarray:
    return (triple >> np.uint64(64 - bits)).astype(np.int64)


def _sketcher(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << bits, np.int64)
        for batch in batches:
            count += np.bincount(_bucket(_listed(batch.column(0))[0], bits), minlength=1 << bits)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], ["bucket", "n"])

    return run


def sketch_bits(partitions: int) -> int:
    """Bits of a bucket's number, from the session's shuffle partitions."""
    return min(max(SKETCH_BITS, (SPREAD * max(partitions, 1) - 1).bit_length()), SKETCH_MOST)


def hot_buckets(sets: DataFrame, bits: int) -> np.ndarray:
    """The buckets of the sketch that hold more than HOT times the mean, over all triples; HOT-th parts of all at most."""
    counts = materialise(sets.select("triples").mapInArrow(_sketcher(bits), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "p5-sketch")
    whole = counts.agg(F.sum("n")).first()[0] or 0
    return np.array([r[0] for r in counts.filter(F.col("n") > max(HOT * whole / (1 << bits), HOT)).select("bucket").collect()], np.int64)


def _posted(triple: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    return ~np.isin(_bucket(triple, bits), hot) & (_finish(triple) < np.uint64(int(POSTED * 2**64)))


def _header(hot: np.ndarray, bits: int):
    """Rows (id, k, n, posted): posted is how many triples a set posts, null for a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            triple, size = _listed(batch.column(3))
            upto = np.concatenate([[0], np.cumsum(_posted(triple, hot, bits))])
            ends = np.cumsum(size)
            posted = pa.array((upto[ends] - upto[ends - size]).astype(np.int32), mask=batch.column(3).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], posted], ["id", "k", "n", "posted"])

    return run


def _poster(hot: np.ndarray, bits: int):
    """Rows (triple, k) of the triples to be posted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            triple, size = _listed(batch.column(1))
            take = _posted(triple, hot, bits)
            yield pa.RecordBatch.from_arrays([_signed(triple[take]), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size)[take])], ["triple", "k"])

    return run


def _needed(n: str) -> F.Column:
    """How many triples a set of n must share with any similar one."""
    return F.ceil(SIMILAR * F.col(n) / WHOLE)


def _segmented(rows: DataFrame) -> DataFrame:
    """(k, n, head, reach, segments) of each set given as rows (k, n, triple, df): its triples in the global order, by fragment.

    head: triples that no other set holds, which come first in the order; reach: the last
    fragment that the prefix touches; sets whose prefix holds such triples only have no row.
    """
    place = F.col("df") + (F.col("triple") / F.lit(2.0**64) + 0.5)
    placed = rows.withColumn("place", place)
    cuts = placed.agg(F.percentile_approx("place", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).first()[0] or []
    fragment = F.lit(0)
    for cut in sorted(set(cuts)):
        fragment = fragment + (F.col("place") > cut).cast("int")
    items = F.array_sort(F.collect_list(F.struct("place", "triple", fragment.alias("fragment"))))
    whole = placed.groupBy("k").agg(F.first("n").alias("n"), items.alias("items")).withColumn("head", F.col("n") - F.size("items"))
    within = (F.col("n") - _needed("n") + 1 - F.col("head")).cast("int")  # items that belong to the prefix
    reached = whole.filter(within > 0).withColumn("reach", F.element_at("items", F.least(within, F.size("items")))["fragment"])
    segments = F.transform(F.sequence(F.lit(0), F.lit(len(set(cuts)))), lambda f: F.transform(F.filter("items", lambda x: x["fragment"] == f), lambda x: x["triple"]))
    return reached.select("k", "n", "head", "reach", segments.alias("segments"))


def fragment_candidates(sets: DataFrame) -> DataFrame:
    """(x, y, reach, shared) of pairs that share a triple in the fragments both take part in, from what _segmented gives.

    shared: the overlap of the fragments up to reach, the lesser of both reaches, summed. Pairs whose
    sizes, or whose first shared triple's place, rule similarity out are left away.
    """
    sent = F.slice("segments", F.lit(1), F.col("reach") + 1)
    before = F.col("head") + F.aggregate(F.slice("segments", F.lit(1), F.col("fragment")), F.lit(0), lambda a, x: a + F.size(x))
    posted = sets.select("k", "n", "head", "reach", "segments", F.posexplode(sent).alias("fragment", "segment"))
    posted = posted.select("k", "n", "reach", "fragment", before.alias("before"), F.posexplode("segment").alias("at", "triple")).select("k", "n", "reach", "fragment", "triple", (F.col("before") + F.col("at") + 1).alias("at"))
    posted = materialise(posted, "p5-fragments")
    held = posted.groupBy("fragment", "triple").agg(F.count("*").alias("held")).filter("held > 1")
    salts = F.ceil(F.col("held") / SALT).cast("int")
    split = posted.join(held, ["fragment", "triple"]).withColumn("salts", salts)
    a = split.select("fragment", "triple", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int").alias("salt"), F.col("k").alias("x"), F.col("n").alias("nx"), F.col("reach").alias("rx"), F.col("at").alias("ax"))
    b = split.select("fragment", "triple", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("k").alias("y"), F.col("n").alias("ny"), F.col("reach").alias("ry"), F.col("at").alias("ay"))
    met = a.join(b.hint("merge"), ["fragment", "triple", "salt"]).filter((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))).filter(WHOLE * F.col("nx") >= SIMILAR * F.col("ny"))
    partial = met.groupBy("x", "nx", "y", "ny", F.least("rx", "ry").alias("reach"), "fragment").agg(F.count("*").alias("shared"), F.min("ax").alias("ax"), F.min("ay").alias("ay"))
    summed = partial.groupBy("x", "nx", "y", "ny", "reach").agg(F.sum("shared").alias("shared"), F.min("ax").alias("ax"), F.min("ay").alias("ay"))
    need = F.ceil(SIMILAR * (F.col("nx") + F.col("ny")) / (SIMILAR + WHOLE))
    return summed.filter(F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) + 1 >= need).select("x", "y", "reach", "shared")


def similar_sets(sets: DataFrame) -> DataFrame:
    """(x, nx, y, ny, shared) of all similar pairs, shared being the whole overlap, from what _segmented gives."""
    candidates = materialise(fragment_candidates(sets), "p5-candidates")
    side = lambda k, s, n: sets.select(F.col("k").alias(k), F.col("segments").alias(s), F.col("n").alias(n)).hint("merge")
    met = candidates.join(side("x", "left", "nx"), "x").join(side("y", "right", "ny"), "y")
    need = F.ceil(SIMILAR * (F.col("nx") + F.col("ny")) / (SIMILAR + WHOLE))
    rest = lambda c: F.slice(c, F.col("reach") + 2, F.size(c))
    open_ = met.select("x", "nx", "y", "ny", "shared", need.alias("need"), F.arrays_zip(rest("left").alias("l"), rest("right").alias("r")).alias("rest"))
    most = F.aggregate("rest", F.lit(0), lambda a, s: a + F.least(F.size(s["l"]), F.size(s["r"])))
    alive = open_.filter(F.col("shared") + most >= F.col("need"))
    more = F.aggregate("rest", F.lit(0), lambda a, s: a + F.size(F.array_intersect(s["l"], s["r"])))
    total = alive.select("x", "nx", "y", "ny", (F.col("shared") + more).alias("shared"))
    return total.filter(WHOLE * F.col("shared") >= SIMILAR * (F.col("nx") + F.col("ny") - F.col("shared")))


def classes_and_links(chunks: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(id, class) with the class's least id, links(a, b, shared, n_a, n_b) between classes, a < b.

    Rows without an id or content take no part; a chunk counts once however often delivered.
    """
    texts = chunks.select(F.col("id").cast("string").alias("id"), F.col("content").alias("content")).filter(F.col("id").isNotNull() & F.col("content").isNotNull())
    bits = sketch_bits(partitions(chunks.sparkSession))
    sets = materialise(texts.mapInArrow(_setter(least), "id string, k long, n int, triples array<long>"), "p5-sets")
    first = sets.filter("triples is not null").select("k", "n", "triples")
    hot = hot_buckets(first, bits)
    heads = materialise(sets.mapInArrow(_header(hot, bits), "id string, k long, n int, posted int"), "p5-heads")
    classes = heads.groupBy("k").agg(F.min("id").alias("class"), F.max("n").alias("n"), F.max("posted").alias("posted"), F.count("posted").alias("times"))
    members = heads.join(classes.select("k", "class").hint("merge"), "k").select("id", "class").distinct()

    by_triple = Window.partitionBy("triple")
    posts = first.select("k", "triples").mapInArrow(_poster(hot, bits), "triple long, k long")
    common = posts.withColumns({"low": F.min("k").over(by_triple), "high": F.max("k").over(by_triple)}).filter("low <> high")
    # a set that several tasks came upon is posted by each of them
    shared = common.groupBy("k").agg(F.count("*").alias("shared"))
    lacking = F.col("posted") - F.coalesce("shared", F.lit(0)) / F.col("times")
    left = materialise(classes.join(shared.hint("merge"), "k", "left").filter(lacking <= F.col("n") - _needed("n")).select("k", "class", "n"), "p5-left")

    rows = first.join(left.select("k").hint("merge"), "k", "left_semi").dropDuplicates(["k"]).select("k", "n", F.explode("triples").alias("triple"))
    rows = materialise(rows, "p5-rows")
    frequency = rows.groupBy("triple").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = materialise(rows.join(frequency.hint("merge"), "triple"), "p5-ordered")
    discard(sets, rows)
    segments = materialise(_segmented(ordered), "p5-segments")
    discard(ordered)
    good = similar_sets(segments)
    name = lambda k, c: left.select(F.col("k").alias(k), F.col("class").alias(c)).hint("merge")
    named = good.join(name("x", "p"), "x").join(name("y", "q"), "y")
    links = named.select(
        F.least("p", "q").alias("a"),
        F.greatest("p", "q").alias("b"),
        F.col("shared").cast("long").alias("shared"),
        F.when(F.col("p") < F.col("q"), F.col("nx")).otherwise(F.col("ny")).alias("n_a"),
        F.when(F.col("p") < F.col("q"), F.col("ny")).otherwise(F.col("nx")).alias("n_b"),
    )
    return members, links


def similar_pairs(chunks: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of chunks sharing at least 7 tenths of their triples, copies included."""
    members, links = classes_and_links(chunks)
    m1 = members.select(F.col("class").alias("a"), F.col("id").alias("i"))
    m2 = members.select(F.col("class").alias("b"), F.col("id").alias("j"))
    across = links.select("a", "b").join(m1, "a").join(m2, "b").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    within = m1.join(m2.withColumnRenamed("b", "a"), "a").filter(F.col("i") < F.col("j")).select(F.col("i").alias("id_a"), F.col("j").alias("id_b"))
    return across.unionByName(within)


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node of edges(a, b): the least node of its component.

    Large-star / small-star contraction: the longest path halves each round and no
    round gathers a component in one task. Edges are written to the shared folder after
    each round, so a lost executor costs one round at most.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        before_now, now = now, materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(before_now)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components of a graph so deep need more than {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicate_groups(chunks: DataFrame) -> DataFrame:
    """(id, class, group_id, links) of every chunk that takes part.

    class: the least id with the same triple set; group_id: the least class reached over
    links; links: how many other classes the chunk's class is similar to. Copies of one
    text are one class and are not expanded into pairs.
    """
    members, links = classes_and_links(chunks)
    members, links = materialise(members, "p5-members"), materialise(links.select("a", "b"), "p5-links")
    roots = components(links).select(F.col("node").alias("class"), "root")
    degree = links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    info = roots.join(degree, "class", "left")
    return members.join(info, "class", "left").select("id", "class", F.coalesce("root", "class").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
