"""Problem 2: oversized chunks cut into overlapping pieces at natural boundaries.

Spark decides in the JVM which chunks exceed a limit (only those reach Python, and
only there is a text handled as lines). Within a chunk the cut is chosen by lexical
cohesion: for every gap between two lines the similarity of the word blocks before
and after it is taken, the depth of a gap is how far its similarity lies below the
peaks on either side, and of the gaps that are natural for the chunk's type inside the
current size window the deepest valley is cut. The next piece starts `overlap` lines
before the cut.

Lines longer than the character limit are first cut into segments (after white space
or punctuation where there is any), so every piece keeps within both limits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import once_by_id

MAX_LINES, MAX_CHARS, OVERLAP = 60, 4000, 8
#: Lines on either side of a gap whose words are compared.
BLOCK = 6

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_WORD = re.compile(r"[A-Za-z]+|[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DEFINITION = re.compile(r"(?:export\s|async\s|public\s|private\s|protected\s|static\s|def\s|class\s|function\s|func\s|fn\s|interface\s|enum\s|type\s|const\s|let\s|var\s|@\w|#\[|impl\s|struct\s|CREATE\s|FROM\s|\[)")
_HEADING = re.compile(r"#{1,6}\s|={3,}|-{3,}|\*{3,}")

PIECES = "id string, piece int, pieces int, start_line int, end_line int, start_char long, end_char long, content string"


def line_total(text: Column) -> Column:
    """Lines of a text: LF and CRLF end a line, a final line end opens none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return ends + ((text != "") & ~F.endswith(text, F.lit("\n"))).cast("int")


def char_total(text: Column) -> Column:
    """Code points of all lines, each line counting one more, line ends not counted."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    pairs = (F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
    return F.length(text) - ends - pairs.cast("long") + line_total(text)


def _segments(text: str, limit: int) -> list[tuple[int, int, int]]:
    """(begin, end, line number from 0) of every line, overlong ones in several segments."""
    out, at = [], 0
    for n, m in enumerate(_LINE.finditer(text)):
        line = m.group()
        size = len(line.rstrip("\n").removesuffix("\r")) if line.endswith("\n") else len(line)
        if size + 1 <= limit:
            out.append((at, at + len(line), n))
        else:
            begin = 0
            while begin < len(line):
                end = min(begin + limit - 1, len(line))
                if end < len(line):
                    floor = begin + (limit - 1) // 2
                    near = max(line.rfind(c, floor, end) for c in " \t;,)}]>")
                    end = near + 1 if near >= floor else end
                elif end - begin > size - begin:
                    end = len(line)
                if size <= begin:  # only the line end is left
                    b, _, k = out.pop()
                    out.append((b, at + len(line), k))
                    break
                out.append((at + begin, at + end, n))
                begin = end
        at += len(line)
    return out


def _words(line: str) -> list[str]:
    return [p.lower() for w in _WORD.findall(line) for p in _CAMEL.split(w) if len(p) > 2]


def gap_depths(lines: list[str], block: int = BLOCK) -> list[float]:
    """Valley depth of the gap before each line; 0 for the first. Runs in one sweep."""
    n = len(lines)
    words = [Counter(_words(x)) for x in lines]
    score = [1.0] * n
    left: Counter = Counter()
    right: Counter = Counter()
    for w in words[:block]:
        right.update(w)
    for g in range(1, n):
        left.update(words[g - 1])
        right.subtract(words[g - 1])
        if g - 1 - block >= 0:
            left.subtract(words[g - 1 - block])
        if g - 1 + block < n:
            right.update(words[g - 1 + block])
        dot = sum(c * right[w] for w, c in left.items() if c and right.get(w))
        norm = (sum(c * c for c in left.values()) * sum(c * c for c in right.values())) ** 0.5
        score[g] = dot / norm if norm else 0.0
    before, after = [0.0] * n, [0.0] * n
    for g in range(1, n):  # the peak reached by climbing from the gap
        before[g] = max(score[g], before[g - 1]) if g > 1 and score[g - 1] >= score[g] else score[g]
    for g in range(n - 1, 0, -1):
        after[g] = max(score[g], after[g + 1]) if g + 1 < n and score[g + 1] >= score[g] else score[g]
    return [0.0] + [before[g] + after[g] - 2 * score[g] for g in range(1, n)]


def natural_gaps(lines: list[str], kind: str) -> list[int]:
    """For the gap before each line: 3 a heading or definition, 2 a blank line, 1 a return to the outer indentation, 0 none."""
    out, depth = [], None
    prose = kind == "section"
    filled = [len(x) - len(x.lstrip()) for x in lines if x.strip()]
    outer = min(filled) if filled else 0
    body = min((d for d in filled if d > outer), default=outer) if kind in ("symbol", "symbol_part", "symbol_header") else outer
    previous = ""
    for line in lines:
        text = line.strip()
        indent = len(line) - len(line.lstrip())
        rank = 0
        if text:
            if prose and _HEADING.match(text):
                rank = 3
            elif not prose and indent <= body and _DEFINITION.match(text) and not previous.startswith("@"):
                rank = 3
            elif not previous:
                rank = 2
            elif not prose and depth is not None and indent < depth and indent <= body and text[:1] not in ")]}":
                rank = 1
            depth = indent
        out.append(rank)
        previous = text
    return out


def cut_text(text: str, kind: str, max_lines: int, max_chars: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, first line, last line) of each piece, characters and lines from 0."""
    segments = _segments(text, max_chars)
    lines = [text[b:e].rstrip("\r\n") for b, e, _ in segments]
    size = [len(x) + 1 for x in lines]
    n = len(lines)
    if n <= max_lines and sum(size) <= max_chars:
        return [(0, len(text), segments[0][2], segments[-1][2])] if n else []
    depths, natural = gap_depths(lines), natural_gaps(lines, kind)
    out, begin, fresh = [], 0, 0  # fresh: first line that no piece holds yet
    while True:
        end, chars = begin, 0
        while end < n and end - begin < max_lines and chars + size[end] <= max_chars:
            chars += size[end]
            end += 1
        if end < n:
            low = max(fresh + 1, begin + (end - begin) // 2)
            window = [g for g in range(low, end + 1) if natural[g]] or [g for g in range(fresh + 1, low) if natural[g]]
            if window:
                end = max(window, key=lambda g: (depths[g] + 0.1 * natural[g], g))
            else:
                end = max(range(min(low, end), end + 1), key=lambda g: (depths[g], g))
        out.append((segments[begin][0], segments[end - 1][1], segments[begin][2], segments[end - 1][2]))
        if end >= n:
            return out
        fresh, begin = end, max(end - overlap, begin + 1)
        while begin < end:  # the overlap and at least one further line must fit
            if sum(size[begin : end + 1]) <= max_chars and end + 1 - begin <= max_lines:
                break
            begin += 1


def _cutter(max_lines: int, max_chars: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, kind, start, text in zip(batch["id"], batch["kind"], batch["start"], batch["text"]):
                pieces = cut_text(text, kind, max_lines, max_chars, overlap)
                for k, (b, e, first, last) in enumerate(pieces):
                    rows.append((key, k + 1, len(pieces), int(start) + first, int(start) + last, b, e, text[b:e]))
            yield pd.DataFrame(rows, columns=["id", "piece", "pieces", "start_line", "end_line", "start_char", "end_char", "content"])

    return run


def split_oversized(chunks: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (see PIECES) of every chunk whose content exceeds a limit.

    Both limits hold for every piece and content[start_char:end_char] of the chunk is the
    piece, so dropping what overlaps gives the content back. Consecutive pieces share
    `overlap` lines, fewer only where these and one further line exceed a limit. A chunk
    counts once however often delivered; chunks within the limits and null contents give no
    piece; a null start_line counts as 1, a null or unknown chunk_type as plain lines.
    """
    text = F.col("content")
    over = chunks.filter((line_total(text) > max_lines) | (char_total(text) > max_chars)).select(
        F.col("id").cast("string").alias("id"),
        F.coalesce(F.lower(F.trim("chunk_type")), F.lit("")).alias("kind"),
        F.coalesce(F.col("start_line").cast("int"), F.lit(1)).alias("start"),
        text.alias("text"),
    )
    return once_by_id(over).mapInPandas(_cutter(max_lines, max_chars, overlap), PIECES)
