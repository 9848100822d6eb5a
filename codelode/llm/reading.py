"""Problem 9: the reading level of each document.

Every sentence's level is classified by a regularised linear model over its words,
over the character n-grams of its words and over its build (length, clauses, share of
long words); a document's estimate comes from the distribution of its sentences'
levels, weighted by their words and calibrated on graded documents. The model is fitted
on a bounded sample of graded documents, is of fixed size and travels to the executors
in the task closure; scoring is one map over the documents without a shuffle.

Only prose counts: code, tables, lists, headings, quotations of code, tracebacks and
addresses are taken out first, and the language is told by the text itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRADES = 5
#: At most so many graded documents, chosen by a hash of their id, and sentences train the model.
MAX_TRAINING_DOCS, MAX_TRAINING_SENTENCES = 600, 6_000
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 12
_DENSE = 8

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_TAGS = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>\n]{0,200}>|&#?\w{1,8};", re.S)
_ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]*://\S+|\bwww\.\S+|\S+@\S+\.\w+|\S*[/\\]\S*[/\\]\S*")
_INLINE = re.compile(r"`[^`\n]*`|!?\[([^\]\n]*)\]\([^)\n]*\)")
_NOT_PROSE = re.compile(r"^\s*(?:#{1,6}\s|[-*+•]\s|\d+[.)]\s|\||>\s|[=\-~*_]{3,}\s*$|File \"|Traceback|at \S+\(|\$ |@\w|[\w-]+:\s*\S*$)|(?: {4}|\t)\S")
_ROW = re.compile(r"\|.*\|")
_MAYBE_ADDRESS = re.compile(r"[/\\@]|www\.")
_CODE = re.compile(r"[{}();=<>\[\]|]|->|::|\w\.\w+\(")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[A-ZÀ-Þ0-9])")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CLAUSE = frozenset(
    "that which who whom whose whereby wherein whereas although though because since while unless if whether notwithstanding insofar inasmuch when where being having rather nor neither thereby before after until".split()
)
#: Frequent words that tell the four languages of such collections apart. Fixed values.
_TELLING = {
    "en": frozenset("the of and to is that it for was with as be on not this are by from or have an they which you were their has its but at if we can will would been so no do".split()),
    "de": frozenset("der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn".split()),
    "fr": frozenset("de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont la avec son aux d l ou mais comme nous leur si cette été ont elle était dès nous".split()),
    "es": frozenset("de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde porque".split()),
    "it": frozenset("di che e la il un a per è in una mi sono ho non ma lo ha le si con cosa come da i o se del della dei gli nel alla anche più".split()),
    "pt": frozenset("de que e o a do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito já está também pelo pela até isso".split()),
    "nl": frozenset("de het een en van ik te dat die in je is niet op met voor zijn er maar om aan ook als dan naar wat nog bij of uit kan deze wordt door".split()),
}


def prose_sentences(text: str) -> list[str]:
    """The sentences of a text's prose."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text or "&" in text:
        text = _TAGS.sub(" ", text)
    if "`" in text or "](" in text:
        text = _INLINE.sub(lambda m: m.group(1) or " ", text)
    blocks: list[list[str]] = [[]]
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or _NOT_PROSE.match(line) or ("|" in line and _ROW.search(line)):
            blocks.append([])
            continue
        if _MAYBE_ADDRESS.search(bare):
            bare = _ADDRESS.sub(" ", bare)
        marks = len(_CODE.findall(bare))
        if marks > 1 and marks * 12 > len(bare):
            blocks.append([])
            continue
        blocks[-1].append(bare)
    out: list[str] = []
    for block in blocks:
        if block:
            out += _SENTENCE.split(" ".join(block))
    return out


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


def _grams(word: str) -> list[int]:
    w = f"<{word}>"
    return [_bucket(w[i : i + n], CHAR_BUCKETS) for n in (3, 4) for i in range(len(w) - n + 1)]


#: What is kept of a token besides its score: its words, their letters, how many are of 9 and of 12
#: letters and more, how many join clauses, its commas, and for which languages they speak.
_TRAITS = 6 + len(_TELLING)


def _traits(token: str, words: list[str]) -> list[float]:
    size = [len(w) for w in words]
    own = [len(words), sum(size), sum(n >= 9 for n in size), sum(n >= 12 for n in size), sum(w in _CLAUSE for w in words), token.count(",") + token.count(";")]
    return own + [sum(w in telling for w in words) for telling in _TELLING.values()]


class Lexicon(dict):
    """Token between white space -> row of `traits` (and of `score` under a model), made when it is first seen."""

    KEEP = 200_000

    def __init__(self, model: "LevelModel | None" = None):
        super().__init__()
        self.model = model
        self.parts: list[list[str]] = []
        self.traits = np.zeros((1024, _TRAITS), np.float32)
        self.score = np.zeros((1024, GRADES))

    def __missing__(self, token: str) -> int:
        k = len(self.parts)
        if k == len(self.traits):
            self.traits = np.concatenate([self.traits, np.zeros_like(self.traits)])
            self.score = np.concatenate([self.score, np.zeros_like(self.score)])
        words = _WORD.findall(token.lower())
        self.parts.append(words)
        self.traits[k] = _traits(token, words)
        if self.model:
            for w in words:
                grams = _grams(w)
                self.score[k] += self.model.word[_bucket(w, WORD_BUCKETS)] + self.model.char[grams].sum(axis=0) / len(grams)
        self[token] = k
        return k


@dataclass
class Sentences:
    """The sentences of some documents: of which document, number of words, first token, row of every token, features."""

    doc: np.ndarray
    size: np.ndarray
    head: np.ndarray
    rows: np.ndarray
    dense: np.ndarray
    telling: np.ndarray


def sentence_table(texts: list[str], lexicon: Lexicon) -> Sentences:
    """All prose sentences of two words and more."""
    doc, tokens, rows = [], [], []
    look = lexicon.__getitem__
    for d, text in enumerate(texts):
        for s in prose_sentences(text) if text else ():
            found = s.split()
            if found:
                doc.append(d)
                tokens.append(len(found))
                rows += map(look, found)
    doc, count, rows = np.array(doc, np.int64), np.array(tokens, np.int64), np.array(rows, np.int64)
    head = np.cumsum(count) - count
    if not len(doc):
        return Sentences(doc, count, head, rows, np.zeros((0, _DENSE)), np.zeros((0, len(_TELLING))))
    sums = np.add.reduceat(lexicon.traits[rows], head, axis=0).astype(np.float64)
    good = sums[:, 0] >= 2
    rows = rows[np.repeat(good, count)]
    doc, count, sums = doc[good], count[good], sums[good]
    head, n = np.cumsum(count) - count, sums[:, 0]
    dense = np.stack(
        [
            np.log(n) - 2.5,
            (n - 15) / 15,
            np.minimum(n, 60) ** 0.5 / 4 - 1,
            sums[:, 1] / n - 5,
            sums[:, 2] / n * 4,
            sums[:, 3] / n * 6,
            np.minimum(sums[:, 4], 6) / 2 - 1,
            np.minimum(sums[:, 5], 8) / 3 - 1,
        ],
        axis=1,
    )
    return Sentences(doc, n.astype(np.int64), head, rows, dense, sums[:, 6:])


def languages(table: Sentences, docs: int) -> list[str | None]:
    """For each document the language most of its words speak for, None where nothing tells."""
    score = np.stack([np.bincount(table.doc, weights=table.telling[:, k], minlength=docs) for k in range(len(_TELLING))], axis=1) if len(table.doc) else np.zeros((docs, len(_TELLING)))
    names = list(_TELLING)
    return [names[int(r.argmax())] if r.max() > 0 else None for r in score]


@dataclass
class LevelModel:
    """Weights of the sentence classifier and of the calibration; some hundred kilobytes."""

    word: np.ndarray
    char: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    calibration: np.ndarray
    hard_share: float


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def distributions(table: Sentences, lexicon: Lexicon) -> np.ndarray:
    """One row of GRADES probabilities for each sentence."""
    if not len(table.size):
        return np.zeros((0, GRADES))
    words = np.add.reduceat(lexicon.score[table.rows], table.head, axis=0) / table.size[:, None]
    return _softmax(words + table.dense @ lexicon.model.dense + lexicon.model.bias)


def by_document(table: Sentences, p: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean distribution, share of words in sentences of the hardest level, words) of each document."""
    words = np.bincount(table.doc, weights=table.size, minlength=docs)
    over = np.maximum(words, 1)
    mean = np.stack([np.bincount(table.doc, weights=table.size * p[:, g], minlength=docs) for g in range(GRADES)], axis=1) / over[:, None]
    top = np.bincount(table.doc, weights=table.size * (p.argmax(axis=1) == GRADES - 1), minlength=docs) / over
    return mean, top, words


def fit_level_model(texts: list[str], grades: list[float], l2: float = 3e-4, steps: int = 80, seed: int = 7) -> LevelModel:
    """Fit sentence weights (ridge-regularised softmax, full-batch Adam) and the calibration."""
    zero = LevelModel(np.zeros((WORD_BUCKETS, GRADES)), np.zeros((CHAR_BUCKETS, GRADES)), np.zeros((_DENSE, GRADES)), np.zeros(GRADES), np.append(np.arange(1.0, GRADES + 1), 0.0), 0.5)
    lexicon = Lexicon()
    whole = sentence_table(texts, lexicon)
    english = np.array([lang == "en" for lang in languages(whole, len(texts))], bool)
    mine = np.flatnonzero(english[whole.doc]) if len(whole.doc) else np.zeros(0, np.int64)
    if not len(mine):
        return zero
    if len(mine) > MAX_TRAINING_SENTENCES:
        mine = np.sort(np.random.default_rng(seed).choice(mine, MAX_TRAINING_SENTENCES, replace=False))
    grade = np.asarray(grades, float)
    row_grade = grade[whole.doc[mine]]
    ends = np.append(whole.head, len(whole.rows))
    tokens = (ends[1:] - ends[:-1])[mine]
    token_at = np.repeat(whole.head[mine] - (np.cumsum(tokens) - tokens), tokens) + np.arange(int(tokens.sum()))
    row = whole.rows[token_at]
    parts = np.array([len(p) for p in lexicon.parts])
    known: dict[str, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for p in lexicon.parts for w in p], np.int64)
    first_part = np.cumsum(parts) - parts
    many = parts[row]
    at = np.repeat(np.repeat(np.arange(len(mine)), tokens), many)
    every = flat[np.repeat(first_part[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    used, col = np.unique(every, return_inverse=True)
    val = 1.0 / whole.size[mine][at]
    names = list(known)
    vocab = [names[k] for k in used]
    bucket = np.array([_bucket(w, WORD_BUCKETS) for w in vocab])
    grams = [_grams(w) for w in vocab]
    g_row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    g_col = np.concatenate([np.array(g) for g in grams])
    g_val = np.repeat([1 / len(g) for g in grams], [len(g) for g in grams])
    dense = whole.dense[mine]
    # a grade between two counts for both in proportion
    target = np.zeros((len(mine), GRADES))
    low = np.clip(np.floor(row_grade), 1, GRADES).astype(int)
    part = np.clip(row_grade - low, 0, 1)
    np.add.at(target, (np.arange(len(mine)), low - 1), 1 - part)
    np.add.at(target, (np.arange(len(mine)), np.minimum(low, GRADES - 1)), part)
    share = target.sum(axis=0)
    balance = (target @ (len(mine) / (GRADES * np.maximum(share, 1.0))) ** 0.5)[:, None]
    V = len(vocab)
    order_c, order_b, order_g = np.argsort(col, kind="stable"), np.argsort(bucket, kind="stable"), np.argsort(g_col, kind="stable")

    def spread(rows_of: np.ndarray, weights: np.ndarray, values: np.ndarray, size: int, order: np.ndarray | None) -> np.ndarray:
        """sum of weights * values by rows_of."""
        if order is not None:
            rows_of, weights, values = rows_of[order], weights[order], values[order]
        out = np.zeros((size, GRADES))
        if len(rows_of):
            heads = np.flatnonzero(np.concatenate([[True], rows_of[1:] != rows_of[:-1]]))
            out[rows_of[heads]] = np.add.reduceat(weights[:, None] * values, heads, axis=0)
        return out

    params = [zero.word.copy(), zero.char.copy(), zero.dense.copy(), zero.bias.copy()]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        word, char, dw, b = params
        per_word = word[bucket] + spread(g_row, g_val, char[g_col], V, None)
        logits = spread(at, val, per_word[col], len(mine), None) + dense @ dw + b
        p = _softmax(logits)
        err = (p - target) * balance / len(mine)
        d_word = spread(col, val, err[at], V, order_c)
        grads = [
            spread(bucket, np.ones(V), d_word, WORD_BUCKETS, order_b) + l2 * word,
            spread(g_col, g_val, d_word[g_row], CHAR_BUCKETS, order_g) + l2 * char,
            dense.T @ err + l2 * dw,
            err.sum(axis=0),
        ]
        for k, g in enumerate(grads):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            params[k] = params[k] - 0.15 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6) * min(1.0, 2 - 2 * step / steps)
    model = LevelModel(*params, zero.calibration, 0.5)
    scored = Lexicon(model)
    table = sentence_table(texts, scored)
    mean, tops, words = by_document(table, distributions(table, scored), len(texts))
    good = english & (words > 0)
    X, y, tops = np.column_stack([mean, np.ones(len(texts))])[good], grade[good], tops[good]
    prior = np.append(np.arange(1.0, GRADES + 1), 0.0)
    model.calibration = prior + np.linalg.solve(X.T @ X + 1.0 * np.eye(GRADES + 1), X.T @ (y - X @ prior))
    hardest = y >= GRADES - 0.5
    if hardest.any() and (~hardest).any():
        # the middle of the thresholds that tell the hardest documents best, between three and seven tenths
        cuts = np.linspace(0.3, 0.7, 41)
        f1 = np.array([2 * (hardest & (tops > c)).sum() / max((tops > c).sum() + hardest.sum(), 1) for c in cuts])
        model.hard_share = float(np.median(cuts[f1 >= f1.max() - 1e-9]))
    return model


def training_sample(documents: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_DOCS) -> pd.DataFrame:
    """(doc_id, text, grade) of at most `limit` graded documents, chosen by a hash of the id."""
    graded = labels.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # `limit` bounds the side that is broadcast
    return documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas()


#: Documents are scored together up to so many characters.
_CHARS_AT_ONCE = 2_000_000


def _score(model: LevelModel):
    def some(keys: list, texts: list, lexicon: Lexicon) -> pd.DataFrame:
        table = sentence_table(texts, lexicon)
        n = len(texts)
        mean, top, words = by_document(table, distributions(table, lexicon), n)
        level = np.clip(np.column_stack([mean, np.ones(n)]) @ model.calibration, 1.0, GRADES)
        none = words == 0
        return pd.DataFrame(
            {
                "doc_id": pd.array(keys, "Int64"),
                "language": languages(table, n),
                "sentences": np.bincount(table.doc, minlength=n).astype(np.int32),
                "words": words.astype(np.int64),
                "level": np.where(none, np.nan, level),
                "hard_share": np.where(none, np.nan, top),
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model)
        for batch in batches:
            keys, texts, chars = [], [], 0
            for key, text in zip(batch["doc_id"], batch["text"]):
                keys.append(None if key is None or key != key else int(key))
                texts.append(text or "")
                chars += len(texts[-1])
                if chars >= _CHARS_AT_ONCE:
                    yield some(keys, texts, lexicon)
                    keys, texts, chars = [], [], 0
                    if len(lexicon) > Lexicon.KEEP:
                        lexicon = Lexicon(model)
            if keys:
                yield some(keys, texts, lexicon)

    return run


def reading_levels(documents: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_DOCS) -> DataFrame:
    """(doc_id, language, sentences, words, level, hard_share, grade) of every document.

    level runs from 1 to 5, grade is the level rounded. The level is calibrated in two pieces that
    meet at 4.5: where the share of the prose's words in sentences of the hardest level reaches the
    fitted share, it lies above, by how far the share exceeds it, else below, by the fitted mixture of
    the sentence levels. The scale is that of English graders; grade and level of a text in another
    language are null, as are those of a text that is null, blank or has no prose. Null grades and
    labels of unknown documents don't count; without any label the grades are those of an untrained
    model. Documents keep their rows.
    """
    sample = training_sample(documents, labels, limit)
    model = fit_level_model(sample["text"].tolist(), sample["grade"].tolist())
    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        _score(model), "doc_id long, language string, sentences int, words long, level double, hard_share double"
    )
    english = (F.col("language") == "en") & (F.col("words") > 0)
    cut, edge = model.hard_share, GRADES - 0.5
    above = F.greatest(F.col("level"), edge + (GRADES - edge) * (F.col("hard_share") - cut) / (1.0 - cut))
    scored = scored.withColumn("level", F.when(F.col("hard_share") > cut, above).otherwise(F.least(F.col("level"), F.lit(edge - 1e-4))))
    return scored.select(
        "doc_id",
        "language",
        "sentences",
        "words",
        F.when(english, F.round("level", 4)).alias("level"),
        F.when(english, F.round("hard_share", 4)).alias("hard_share"),
        F.when(english, F.round("level").cast("int")).alias("grade"),
    )
