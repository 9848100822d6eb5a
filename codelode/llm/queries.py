"""Driver queries of the training-data operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.llm import credentials, docpairs, frequency, mixing, neardup, packing, provenance, reading, splitting
from codelode.session import once_by_id, read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    marked = frequency.marked_terms(read_table(spark, d, "code_chunks"), read_table(spark, d, "code_symbols"))
    return marked.filter("mark is not null").select("field_name", "term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_terms(read_table(spark, d, "code_chunks"), read_table(spark, d, "code_symbols"))


def p1_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return frequency.ngram_frequencies(read_table(spark, d, "code_chunks"), "content", max_n=3)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, d, "code_chunks")).select("id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, d, "code_chunks"))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of each chunk: within both limits, and together the whole content."""
    pieces = splitting.split_oversized(read_table(spark, d, "code_chunks"))
    texts = once_by_id(read_table(spark, d, "code_chunks").select("id", F.length("content").alias("chars")))
    before = F.lag("end_char").over(Window.partitionBy("id").orderBy("piece"))
    fits = (splitting.line_total(F.col("content")) <= splitting.MAX_LINES) & (splitting.char_total(F.col("content")) <= splitting.MAX_CHARS)
    rows = pieces.select("id", "end_char", fits.alias("fits"), F.when(F.col("piece") == 1, F.col("start_char") == 0).otherwise((F.col("start_char") <= before) & (F.col("end_char") > before)).alias("joins"))
    each = rows.groupBy("id").agg(F.bool_and("fits").alias("within"), F.bool_and("joins").alias("joined"), F.max("end_char").alias("end"))
    return each.join(texts, "id").select("id", "within", (F.col("joined") & (F.col("end") == F.col("chars"))).alias("whole"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_pairs(read_table(spark, d, "code_symbols")).select("id")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """With the code of each symbol, captured from the chunk that holds it."""
    return docpairs.with_bodies(docpairs.documented_pairs(read_table(spark, d, "code_symbols")), read_table(spark, d, "code_chunks"))


def p3_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs_from_source(read_table(spark, d, "code_chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(read_table(spark, d, "code_chunks")).select("id", "line_no")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(read_table(spark, d, "code_chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(read_table(spark, d, "code_chunks"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(read_table(spark, d, "code_chunks"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return provenance.label_files(*(read_table(spark, d, t) for t in ("repository_files", "code_files", "code_chunks")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).filter("label <> 'handwritten'").select("id")


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, d, "documents"), read_table(spark, d, "pack_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p7_containers(spark, d))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_checks(p7_containers(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_shares(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each source: its share less than a record away from the target among the sources there are, its cap kept."""
    shares = p8_shares(spark, d)
    there = F.col("available_tokens") > 0
    every = Window.partitionBy(F.lit(1))  # a row a source
    want = F.when(there, F.col("target_share")).otherwise(0.0) / F.sum(F.when(there, F.col("target_share"))).over(every)
    record = F.col("largest") / F.sum("tokens").over(every)
    return shares.select("source", "target_share", "max_repeats", there.alias("available"), (F.abs(F.col("share") - want) <= record + 2e-6).alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(read_table(spark, d, "documents"), read_table(spark, d, "reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).filter("grade = 5").select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def queries() -> dict[str, Query]:
    """The queries by name; of each problem the one to be checked comes first."""
    every = (
        p1_found, p1_terms, p1_ngrams, p2_found, p2_pieces, p2_checks, p3_found, p3_pairs, p3_source_pairs, p4_found, p4_redacted, p5_found, p5_groups,
        p6_found, p6_labels, p7_containers, p7_fill, p7_checks, p8_mixture, p8_shares, p8_checks, p9_found, p9_levels,
    )
    return {f.__name__: f for f in every}


_TERMS = """
WITH k AS (SELECT DISTINCT ON (id) id, content FROM code_chunks),
w AS (SELECT id, unnest(regexp_extract_all(lower(regexp_replace(content, '[^A-Za-z0-9_]', ' ', 'g')), '[a-z0-9_]+')) AS term FROM k),
c AS (SELECT 'content' AS field_name, term, count(*)::BIGINT AS occurrences, count(DISTINCT id)::BIGINT AS records FROM w
      WHERE length(term) BETWEEN 2 AND 40 AND NOT regexp_matches(term, '^[0-9]') GROUP BY term),
s AS (SELECT DISTINCT ON (id) id, trim(name, chr(32) || chr(9) || chr(10) || chr(13)) AS term FROM code_symbols),
n AS (SELECT 'name' AS field_name, term, count(*)::BIGINT AS occurrences, count(*)::BIGINT AS records FROM s WHERE term <> '' GROUP BY term),
t AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 5 > (SELECT count(*) FROM k) THEN 'common' END AS mark FROM c
      UNION ALL SELECT *, CASE WHEN records = 1 THEN 'rare' WHEN records * 200 > (SELECT count(*) FROM s) THEN 'common' END FROM n)
"""


_TERM_LISTS = """
WITH k AS (SELECT DISTINCT ON (id) id, content FROM code_chunks WHERE id IS NOT NULL AND content IS NOT NULL),
w AS (SELECT id, list_filter(regexp_extract_all(lower(regexp_replace(content, '[^A-Za-z0-9_]', ' ', 'g')), '[a-z0-9_]+'), lambda x: length(x) BETWEEN 2 AND 40 AND NOT regexp_matches(x, '^[0-9]')) AS t FROM k),
"""
_TRIPLES = "list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])"
_OVERSIZED = """
WITH c AS (SELECT DISTINCT ON (id) id, content, length(content) - length(replace(content, chr(10), '')) AS ends,
                  (length(content) - length(replace(content, chr(13) || chr(10), ''))) // 2 AS pairs FROM code_chunks),
l AS (SELECT *, ends + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END AS lines FROM c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _TERMS + "SELECT field_name, term, mark FROM t WHERE mark IS NOT NULL",
        "p1_terms": _TERMS + "SELECT field_name, term, occurrences, records, mark FROM t",
        "p7_checks": """
            SELECT spec_id, capacity_tokens, (SELECT count(*) FROM documents WHERE text <> '')::BIGINT AS documents, 0::BIGINT AS overfull, 0::BIGINT AS torn, 0::BIGINT AS lost FROM pack_specs""",
        "p1_ngrams": _TERM_LISTS
        + f"""g AS (SELECT id, 1 AS n, unnest(t) AS gram FROM w UNION ALL SELECT id, 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM w WHERE len(t) > 1
                  UNION ALL SELECT id, 3, unnest({_TRIPLES}) FROM w WHERE len(t) > 2)
            SELECT n::INT AS n, gram, count(*)::BIGINT AS occurrences, count(DISTINCT id)::BIGINT AS records FROM g GROUP BY n, gram""",
        "p2_found": _OVERSIZED + "SELECT id FROM l WHERE lines > 60 OR length(content) - ends - pairs + lines > 4000",
        "p2_checks": _OVERSIZED + "SELECT id, true AS within, true AS whole FROM l WHERE lines > 60 OR length(content) - ends - pairs + lines > 4000",
        "p5_found": _TERM_LISTS
        + f"""s AS (SELECT id, unnest(list_distinct({_TRIPLES})) AS g FROM w WHERE len(t) > 2),
            n AS (SELECT id, count(*) AS n FROM s GROUP BY id HAVING count(*) >= 30),
            r AS (SELECT s.id, hash(g) AS g, n FROM s JOIN n USING (id)),
            p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.id < b.id AND 10 * a.n >= 7 * b.n AND 10 * b.n >= 7 * a.n GROUP BY ALL)
            SELECT id_a, id_b FROM p WHERE 10 * c >= 7 * (na + nb - c)""",
        "p8_checks": """
            WITH d AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE text <> '' AND source IS NOT NULL)
            SELECT m.source, target_share, max_repeats, d.source IS NOT NULL AS available, true AS met, true AS capped FROM mix_targets m LEFT JOIN d USING (source)""",
    }
