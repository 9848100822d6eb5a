"""Tokenizer for source text and the scalar text expressions, all as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that no index keeps. Fixed values.
STOPWORDS = (
    "a about after an and are as async at await be been before being between by can class cls const could def did do does doing done down during else export false for from function had has have "
    "here if import in instanceof into is it its let may might must new none not null of on or out over return self shall should than that the then there these this those to true typeof undefined "
    "under up var was were will with would"
).split()
TOKEN_MIN, TOKEN_MAX = 2, 40
#: What a word is, and a part of one. Fixed values.
WORD = r"([A-Za-z][A-Za-z0-9_]*|\p{Nd}+)"
PART = r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|\p{Nd}+)"


def words(text: Column) -> Column:
    """Identifiers and numbers of at most 40 characters, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), lambda w: F.length(w) <= TOKEN_MAX)


def parts(word: Column) -> Column:
    """`getUserByID` as get, user, by, id."""
    return F.transform(F.regexp_extract_all(word, F.lit(PART), F.lit(1)), F.lower)


def stem(token: Column) -> Column:
    """The first suffix that fits is cut off: ies, sses, ing, ed, es, s; words in ss stay."""
    cut = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    long = lambda n, suffix: (F.length(token) > n) & F.endswith(token, F.lit(suffix))
    return (
        F.when(F.endswith(token, F.lit("ss")), token)
        .when(long(4, "ies"), F.concat(cut(3), F.lit("y")))
        .when(long(5, "sses"), cut(2))
        .when(long(5, "ing"), cut(3))
        .when(long(5, "ed"), cut(2))
        .when(long(4, "es"), cut(2))
        .when(long(3, "s"), cut(1))
        .otherwise(token)
    )


def _kept(token: Column) -> Column:
    return F.length(token).between(TOKEN_MIN, TOKEN_MAX) & ~token.isin(*STOPWORDS)


def _with_parts(word: Column) -> Column:
    """struct(word, its parts); words without capitals and underscores skip the pattern."""
    plain = (word == F.lower(word)) & ~F.contains(word, F.lit("_"))
    return F.struct(word.alias("w"), F.when(plain, F.array(word)).otherwise(parts(word)).alias("p"))


def _emitted(pair: Column) -> Column:
    whole = F.lower(F.replace(pair["w"], F.lit("_"), F.lit("")))
    return F.when(F.size(pair["p"]) > 1, F.array_append(pair["p"], whole)).otherwise(pair["p"])


def tokens(text: Column) -> Column:
    """Stemmed parts of every word and, of words in several parts, the whole; null text gives none."""
    pairs = F.transform(words(F.coalesce(text, F.lit(""))), _with_parts)
    return F.transform(F.filter(F.flatten(F.transform(pairs, _emitted)), _kept), stem)


def path_tokens(path: Column) -> Column:
    return tokens(F.translate(path, "/.-", "   "))


def chunk_header(path: Column, language: Column, chunk_type: Column, symbol_type: Column, name: Column) -> Column:
    """`path (language) - kind name`, without the kind where there is no name."""
    lead = F.concat(path, F.lit(" ("), language, F.lit(")"))
    named = F.concat(lead, F.lit(" - "), F.coalesce(symbol_type, chunk_type), F.lit(" "), name)
    return F.when(F.coalesce(name, F.lit("")) != "", named).otherwise(lead)


def chunk_index_tokens(chunks: DataFrame) -> Column:
    """Tokens a chunk is indexed by: header, content, and the path once more."""
    header = chunk_header(F.col("file_path"), F.col("language"), F.col("chunk_type"), F.col("symbol_type"), F.col("qualified_name"))
    return F.concat(tokens(F.concat_ws("\n", header, F.col("content"))), path_tokens(F.col("file_path")))


def chunk_index_text(chunks: DataFrame) -> Column:
    """The text whose tokens are chunk_index_tokens, path last."""
    header = chunk_header(F.col("file_path"), F.col("language"), F.col("chunk_type"), F.col("symbol_type"), F.col("qualified_name"))
    return F.concat_ws("\n", header, F.col("content"), F.translate("file_path", "/.-", "   "))


def collapse(text: Column, limit: int = 300) -> Column:
    """White space run together, cut to the limit with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def line_count(text: Column) -> Column:
    """Line feeds, and a last line that none ends."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + ((text != "") & ~F.endswith(text, F.lit("\n"))).cast("int")).cast("int")


def contains_ci(column: Column, query: str) -> Column:
    """Case-insensitive substring test; no character of the query is a wildcard."""
    return F.contains(F.lower(column), F.lit(query.lower()))
