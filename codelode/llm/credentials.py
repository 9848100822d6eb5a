"""Problem 4: literal credentials in source and configuration text, found and blanked out.

Each block of chunks gets a trigram index; the trigrams that a detector's pattern
requires are derived from the pattern itself, its postings are intersected, and the
pattern runs on the candidates only. The index lives beside its block: nothing is
shuffled but the rows found.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.terms import as_string
from codelode.llm.trigrams import BlockIndex, required, trigrams_of
from codelode.session import once_by_id

#: What a name ends with when its value is a credential. Fixed values.
_NAME = (
    r"(?:pass(?:word|wd|phrase|code)|passwd|[_-]pass|\bpass|pwd|secret(?:[_-]?access[_-]?key|[_-]?key|[_-]?token)?|token|jwt|credentials?|"
    r"api[_-]?key|access[_-]?key(?:[_-]?id)?|(?:sign(?:ing|ature)?|encrypt(?:ion)?|decrypt(?:ion)?|private|maps|payment|master|service|account|auth|license|deploy|storage|shared|client|ssh|tls|ssl|aws|hmac|session|webhook|cipher|admin|root|server|stripe|google|azure|db)[_-]?key)"
)
_AFTER_NAME = (
    r"(?![A-Za-z0-9])(?:[\"'`\])*]{0,4}\s{0,4})(?::\s{0,2}[A-Za-z]+(?:\[[A-Za-z]+\])?(?:\s?\|\s?\w+)?\s{0,2}=|:=|=>|->|\|\|=|\?\?=?|\|\||={1,3}|,\s{0,2}[\"']?value[\"']?\s{0,2}[:=]|\s[\"']?value[\"']?\s{0,2}[:=]|:|,|\||>|\bis\b|\bby\b|\bwith\b)?\s{0,8}"
)
#: Patterns whose group `value` is the credential. `judge` tells how the value is tested.
#: Values have no greatest length; where one is followed by a sign that it can't hold, it is possessive.
DETECTORS: tuple[tuple[str, str, str], ...] = (
    ("cloud key id", r"(?<![A-Za-z0-9])(?P<value>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])", "exact"),
    ("host token", r"(?<![A-Za-z0-9])(?P<value>gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{18,})", "exact"),
    ("chat token", r"(?<![A-Za-z0-9])(?P<value>xox[abeoprs]-[A-Za-z0-9-]{12,}|xapp-[A-Za-z0-9-]{20,})", "exact"),
    ("maps key", r"(?<![A-Za-z0-9])(?P<value>AIza[A-Za-z0-9_-]{30,})", "exact"),
    ("registry token", r"(?<![A-Za-z0-9])(?P<value>npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}|dckr_pat_[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{30,})", "exact"),
    ("payment key", r"(?<![A-Za-z0-9])(?P<value>[sr]k_(?:live|test)_[A-Za-z0-9]{14,}|whsec_[A-Za-z0-9+/=]{20,}|sq0csp-[A-Za-z0-9_-]{40,})", "exact"),
    ("service token", r"(?<![A-Za-z0-9])(?P<value>SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|shp(?:at|ss|ca|pa)_[a-f0-9]{32}|dop_v1_[a-f0-9]{64}|ya29\.[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9_-]{32,}|hvs\.[A-Za-z0-9_-]{20,})", "exact"),
    ("webhook address", r"hooks\.slack\.com/services/(?P<value>T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{16,})", "exact"),
    ("signed session", r"(?<![A-Za-z0-9])(?P<value>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", "exact"),
    ("private key", r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----(?P<value>(?:\\[rn]|[\"'`+\s#/*;,\\-]|(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*){0,60}[A-Za-z0-9+/=]{16,})", "key"),
    ("address", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@\"'`<>]{0,80}:(?P<value>[^\s/@\"'`<>]{3,}+)@[A-Za-z0-9\[{$.-]", "address"),
    ("address query", r"[?&](?:api[_-]?key|key|sig|signature|[a-z_]{0,20}token|auth|secret|client_secret|password|passwd|pwd|sid|code)=(?P<value>[^&\s\"'`<>|)]{8,})", "plain"),
    ("header", r"authorization[\"'\])]{0,3}\s{0,3}[:=,]{1,2}\s{0,3}[\"'`]{0,2}\s{0,2}(?P<scheme>basic|bearer|token|digest|apikey)\s{1,3}(?P<value>[^\s\"'`,;<>]{6,})", "header"),
    ("cookie", r"cookie[\"'\])]{0,3}[:=,\s]{1,3}[\"'`]?(?:[^\n\"'`]{0,80}[;\s])?(?:[A-Za-z_]{0,12}sid|[A-Za-z_]{0,12}session(?:_?id)?|auth|jwt|[A-Za-z_]{0,12}token)=(?P<value>[^;\s\"'`]{8,})", "plain"),
    ("command user", r"(?:curl|wget|http|https)\b[^\n]{0,200}?\s(?:-u|--user|--proxy-user)[\s=]{1,2}[\"']?[^\s:\"']{1,64}:(?P<value>[^\s\"']{4,})", "user"),
    ("command password", r"(?:sshpass\s{1,2}-p|mysql\w{0,8}\b[^\n]{0,100}?\s-p|redis-cli\b[^\n]{0,100}?\s-a|docker\s{1,2}login\b[^\n]{0,100}?\s-p)\s?[\"']?(?P<value>[^\s\"']{6,})", "plain"),
    ("short name", r"(?<![A-Za-z0-9])pw(?: is |: ?|= ?| = )[\"'`]?(?P<value>[^\s\"'`,;]{5,})", "plain"),
    ("named, quoted", _NAME + _AFTER_NAME + r"(?:[A-Za-z_.]{1,24}\(\s{0,2})?[rbuf@$]{0,2}(?P<quote>[\"'`])(?P<value>[^\"'`\n]{4,}+)(?P=quote)", "named"),
    ("named, bare", _NAME + _AFTER_NAME + r"(?P<value>[^\s\"'`,;|<>(){}\[\]]{5,}+)(?=[\s,;|<\"'`)}]|$)", "bare"),
    ("named, next line", r"name[\"']?\s{0,2}[:=]\s{0,2}[\"']?[A-Za-z0-9_.-]{0,60}" + _NAME + r"[\"']?,?[ \t]{0,4}\r?\n[ \t-]{0,40}[\"']?value[\"']?\s{0,2}[:=]\s{0,2}[\"']?(?P<value>[^\s\"']{5,})", "plain"),
)
_COMPILED = tuple((name, re.compile(p, re.I | re.M) if name not in ("cloud key id", "signed session", "maps key", "private key") else re.compile(p, re.M), judge) for name, p, judge in DETECTORS)
_QUERIES = tuple(required(p) for _, p, _ in DETECTORS)
_WANTED = sorted(set().union(*map(trigrams_of, _QUERIES)))
#: A string literal that goes on in the next literal of the same line.
_JOIN = re.compile(r"(?P<q>[\"'`])[ \t]*(?:\+|\.{1,2}|&|\|\||<>|\\)?[ \t]*(?P=q)(?=[^\s\"'`,;)\]}])")
_JOINED = _COMPILED[:9] + tuple(x for x in _COMPILED if x[0] in ("address", "named, quoted"))
_JOINED_QUERIES = tuple(q for q, x in zip(_QUERIES, _COMPILED) if x in _JOINED)

#: Values that stand for "put yours here", or point elsewhere. Fixed values.
_PLACEHOLDER = re.compile(
    r"\$\{|\$\(|\{\{|\}\}|^\$\w|^%\w+%$|^<.*>?$|^\{.*\}$|%\(|^[*x.#_?-]+$|x{6,}|\*{4,}|\.{3}|"
    r"change[_-]?me|replace[_-]?(?:me|with|this)|^your|your[_-]|[_-]here$|^my[_-]|^insert|^enter|^todo|^fixme|^tbd|^none$|^null$|^nil$|^true$|^false$|^undefined$|^empty$|"
    r"example|sample|dummy|placeholder|redacted|masked|hidden$|^(?:secret|password|passwd|token|pass|pwd|key|test|user|foo|bar|string|str|value|default)[_-]?\d{0,3}$|"
    r"os\.environ|process\.env|getenv|^env[.:\[]|^vault[.:/]|^secrets?[.:/]|^arn:|^ref\+|^op://|^ssm:|^file:|^sha(?:1|256|384|512)[:-]|^md5:|^ssh-(?:rsa|ed25519)",
    re.I,
)
_PATH = re.compile(r"^(?:\.{0,2}/)?[a-z0-9_.-]+(?:/[a-z0-9_.-]+)+/?$")
_REFERENCE = re.compile(r"^[A-Za-z_$][\w$]*(?:(?:\.|->|::|\?\.)[A-Za-z_$][\w$]*)+$|^[A-Za-z_$][\w$.]*\(|^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$")
#: Languages in which a bare word after a name is a value, not an expression.
_PLAIN_LANGUAGES = ("yaml", "toml", "ini", "shell", "dockerfile", "markdown", "mdx", "restructuredtext", "sql", "json", "xml", "properties", "text", "env", "html", "css", "csv")
_PLAIN_SUFFIX = re.compile(r"(?:\.(?:ya?ml|toml|ini|cfg|conf|env|properties|sh|bash|zsh|md|mdx|rst|txt|sql|json|xml|netrc|npmrc|pypirc|tf|tfvars|html?|csv|log)|(?:^|/)(?:dockerfile|makefile|\.env)[^/]*)$", re.I)
_COMMENT = re.compile(r"(?:^|\s)(?:#|//|--|;|/?\*+|<!--|\"{3}|'{3})")


def placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.search(value)) or len(set(value)) < 4


def _mixed(value: str) -> bool:
    """Letters and digits, or letters of both cases with a sign: what a chosen password or key has."""
    letter, digit = re.search(r"[A-Za-z]", value), re.search(r"\d", value)
    return bool(letter and digit) or bool(re.search(r"[a-z]", value) and re.search(r"[A-Z]", value) and re.search(r"[#!@%^&+~]", value))


def _reference(value: str) -> bool:
    """A name or call of the program; a dotted word that holds digits is a password."""
    return bool(_REFERENCE.match(value)) and (value.isupper() or "(" in value or not re.search(r"\d", value))


def _scattered(value: str) -> bool:
    """Letters whose cases change as they don't in words."""
    return len(value) >= 10 and len(re.findall(r"[A-Z]{2}|(?<=[A-Z])[a-z](?=[A-Z])", value)) >= 2 and bool(re.search(r"[a-z]", value))


def genuine(value: str, judge: str, match: re.Match | None = None) -> bool:
    """Whether a captured value would open something as it stands."""
    if judge == "exact":
        body = re.split(r"[_-]", value)[-1] if not value.startswith("eyJ") else value
        return not re.search(r"(?i)example|x{6,}|\*{3,}|your|0{8,}|1234567890", value) and len(set(body)) >= 5
    if judge == "key":
        run = re.search(r"[A-Za-z0-9+/=]{16,}$", value).group()
        return len(set(run)) >= 6
    if placeholder(value):
        return False
    if judge == "header" and match.group("scheme").lower() == "basic":
        try:
            plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
        except (binascii.Error, UnicodeDecodeError, ValueError):
            return len(value) >= 16 and _mixed(value)
        return ":" in plain and not placeholder(plain.partition(":")[2] or "x")
    if judge == "address":
        return len(value) >= 4 and not _reference(value) and bool(re.search(r"\d", value) or _mixed(value) or len(value) >= 8)
    if judge == "header":
        return len(value) >= 8 and _mixed(value)
    if judge == "user":
        return len(value) >= 5 and (_mixed(value) or _scattered(value))
    if len(value) < 5 or not _mixed(value) or _PATH.match(value) or re.match(r"[a-z][a-z0-9+.-]*://", value, re.I):
        return False
    if re.search(r"\s", value):
        return False
    return not (judge == "bare" and _reference(value))


def _plain(path: str | None, language: str | None) -> bool:
    return (language or "").lower() in _PLAIN_LANGUAGES or bool(_PLAIN_SUFFIX.search(path or ""))


def _bare_allowed(text: str, at: int, plain: bool) -> bool:
    if plain:
        return True
    begin = text.rfind("\n", 0, at) + 1
    head = text[begin:at]
    return bool(_COMMENT.search(head)) or head.lstrip()[:1] in ("*", "#")


def _joined(text: str) -> tuple[str, list[tuple[int, int]]] | None:
    """The text with literals put together within a line, and (place in it, place in text) where they were."""
    parts, steps, last, out = [], [(0, 0)], 0, 0
    for m in _JOIN.finditer(text):
        if m.end() - m.start() < 3:  # an empty literal
            continue
        parts.append(text[last : m.start()])
        out += m.start() - last
        last = m.end()
        steps.append((out, last))
    return ("".join(parts) + text[last:], steps) if last else None


#: Stems of which every name holds one, and what a line must hold for its value to be mixed.
_STEMS = ("pass", "pwd", "secret", "token", "jwt", "credential", "key")
_SIGN = re.compile(r"[0-9#!@%^&+~]")


def _lines_with_names(text: str) -> list[tuple[int, int]]:
    """The lines that may hold a name with a value, found by plain search."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    ranges: set[tuple[int, int]] = set()
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            begin, end = low.rfind("\n", 0, at) + 1, low.find("\n", at)
            end = len(low) if end < 0 else end
            if _SIGN.search(low, begin, end):
                ranges.add((begin, end))
            at = low.find(stem, end)
    return sorted(ranges)


def spans(text: str, plain: bool, run: np.ndarray | None = None, run_joined: np.ndarray | None = None) -> list[tuple[int, int, str, int]]:
    """(begin, end, detector, where it counts) of every credential in a text. run, run_joined: which detectors are worth
    running on it as it stands, and with split literals put together."""
    found = []
    named = None
    for k, (name, pattern, judge) in enumerate(_COMPILED):
        if run is not None and not run[k]:
            continue
        if judge in ("named", "bare"):
            named = _lines_with_names(text) if named is None else named
            for begin, end in named:
                found += _scan(text, begin, end, name, pattern, judge, plain)
        else:
            found += _scan(text, 0, len(text), name, pattern, judge, plain)
    spread = _joined(text) if run_joined is None or run_joined.any() else None
    if spread:
        whole, steps = spread
        places = [s[0] for s in steps]
        for n, (name, pattern, judge) in enumerate(_JOINED):
            if run_joined is not None and not run_joined[n]:
                continue
            for m in pattern.finditer(whole):
                b, e = m.span("value")
                k, j = bisect_right(places, b) - 1, bisect_right(places, e - 1) - 1
                if k != j and genuine(m.group("value"), judge, m):
                    b2, e2 = steps[k][1] + b - steps[k][0], steps[j][1] + e - steps[j][0]
                    found.append((b2, e2, name, b2))
    return sorted(set(found), key=lambda x: x[3])


def _scan(text: str, begin: int, end: int, name: str, pattern: re.Pattern, judge: str, plain: bool) -> list[tuple[int, int, str, int]]:
    found = []
    at = begin
    while m := pattern.search(text, at, end):
        value, (b, e) = m.group("value"), m.span("value")
        if judge == "bare":
            value = value.rstrip(".:*")
            e = b + len(value)
        good = genuine(value, judge, m) and (judge != "bare" or _bare_allowed(text, m.start(), plain))
        if good:
            found.append((b, e, name, m.start()) if judge == "key" else (b, e, name, b))
        at = m.end() if good and m.end() > m.start() else m.start() + 1
        if not good and judge in ("named", "bare"):
            at = max(at, m.start() + 3)
    return found


def redact(text: str, found: list[tuple[int, int, str, int]]) -> str:
    """text with every credential's characters blanked by `x`; quotes, joints and line ends stay."""
    out = list(text)
    for b, e, name, _ in found:
        if name == "private key":
            stop = text.find("-----END", b)
            e = stop if stop >= 0 else max(e, (re.compile(r"(?:[A-Za-z0-9+/=]{20,}|\\n|[\s#*/\"'+])+").match(text, b) or re.match("", "")).end())
            for m in re.finditer(r"\\[rn]|[A-Za-z0-9+/=]{8,}", text[b:e]):
                if not m.group().startswith("\\"):
                    out[b + m.start() : b + m.end()] = "x" * (m.end() - m.start())
            continue
        joints = [m.span() for m in _JOIN.finditer(text, b, e)]
        for k in range(b, e):
            if not any(i <= k < j for i, j in joints):
                out[k] = "x"
    return "".join(out)


def _joined_hits(index: BlockIndex, texts: pa.Array) -> np.ndarray:
    """For each pattern that runs on texts with split literals put together, whether each text is its candidate then."""
    hits = np.zeros((len(_JOINED_QUERIES), len(texts)), bool)
    whole = [(r, joined[0]) for r, text in enumerate(texts.to_pylist()) if (joined := _joined(text))]
    if whole:
        index.build(pa.array([t for _, t in whole], pa.large_string()))
        hits[:, [r for r, _ in whole]] = [index.candidates(q) for q in _JOINED_QUERIES]
    return hits


def _finder(blank: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = BlockIndex(_WANTED)
        for batch in batches:
            texts = as_string(batch.column(3))
            index.build(texts)
            hits = np.stack([index.candidates(q) for q in _QUERIES])
            joined = _joined_hits(index, texts)
            rows = np.flatnonzero(hits.any(axis=0) | joined.any(axis=0))
            ids, paths, languages = (batch.column(k) for k in range(3))
            out_id, out_line, out_kind, out_text, out_n = [], [], [], [], []
            for r in rows.tolist():
                text = texts[r].as_py()
                found = spans(text, _plain(paths[r].as_py(), languages[r].as_py()), hits[:, r], joined[:, r])
                if not found:
                    continue
                if blank:
                    out_id.append(ids[r].as_py())
                    out_text.append(redact(text, found))
                    out_n.append(len(found))
                    continue
                for _, _, name, at in found:
                    out_id.append(ids[r].as_py())
                    out_line.append(text.count("\n", 0, at) + 1)
                    out_kind.append(name)
            if blank:
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.string()), pa.array(out_n, pa.int32()), pa.array(out_text, pa.string())], ["id", "credentials", "content"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.string()), pa.array(out_line, pa.int32()), pa.array(out_kind, pa.string())], ["id", "line_no", "kind"])

    return run


def _input(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").cast("string").alias("id"), "file_path", "language", "content").filter(F.col("content").isNotNull())


def find_credentials(chunks: DataFrame) -> DataFrame:
    """(id, line_no, kind) of every line at which a credential begins, kind the pattern that found it.

    Null and empty contents have none. A chunk counts once however often delivered, rows of
    a null id together. An unknown path or language counts as program code, where a bare
    word is no value outside comments.
    """
    return _input(chunks).mapInArrow(_finder(False), "id string, line_no int, kind string").groupBy("id", "line_no").agg(F.min("kind").alias("kind"))


def redacted(chunks: DataFrame) -> DataFrame:
    """(id, credentials, content) of every chunk that held credentials, these blanked out.

    The text keeps its length, quotes and line ends; redacting it again finds nothing.
    """
    return once_by_id(_input(chunks).mapInArrow(_finder(True), "id string, credentials int, content string"))
