"""Problem 3: functions and methods paired with what their documentation says.

Every candidate is laid out as source text (comment, signature, body) and captured by
one recursive pattern of the `regex` library: comment, signature with balanced brackets
and balanced body together, strings protected. The captured comment is then reduced to
its prose; captures whose prose says nothing about the code are dropped. The work is a
map over rows: the only shuffle drops rows that were delivered twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import once_by_id

#: What is once read is not read otherwise, so a match takes one pass; strings and comments are protected.
_FIRM = r"""
(?(DEFINE)
  (?P<com> //[^\n]*+ | /\*(?:[^*]|\*(?!/))*+\*/ )
  (?P<str> "(?:[^"\\\n]|\\.)*+" | '(?:[^'\\\n]|\\.)*+' | `(?:[^`\\]|\\.)*+` )
  (?P<par> \( (?> [^()\[\]{}"'`/]++ | (?=/)(?&com) | (?=["'`])(?&str) | (?=\()(?&par) | (?=\[)(?&brk) | (?=\{)(?&brc) | ["'`/] )*+ \) )
  (?P<brk> \[ (?> [^()\[\]{}"'`/]++ | (?=/)(?&com) | (?=["'`])(?&str) | (?=\()(?&par) | (?=\[)(?&brk) | (?=\{)(?&brc) | ["'`/] )*+ \] )
  (?P<brc> \{ (?> [^()\[\]{}"'`/]++ | (?=/)(?&com) | (?=["'`])(?&str) | (?=\()(?&par) | (?=\[)(?&brk) | (?=\{)(?&brc) | ["'`/] )*+ \} )
  (?P<shb> \{ (?> \\. | "(?:[^"\\\n]|\\.)*+" | '[^'\n]*+' | (?&shb) | [^{}"'\\]++ | ["'\\] )*+ \} )
)
"""
#: Brackets of Python, where `#` begins a comment and strings may have three quotes.
_FIRM_PYTHON = r"""
(?(DEFINE)
  (?P<str> \"{3}(?:[^"\\]|\\(?s:.)|\"(?!\"\"))*+\"{3} | '{3}(?:[^'\\]|\\(?s:.)|'(?!''))*+'{3} | "(?:[^"\\\n]|\\.)*+" | '(?:[^'\\\n]|\\.)*+' )
  (?P<par> [(\[{] (?> [^()\[\]{}"'\#]++ | \#[^\n]*+ | (?=["'])(?&str) | (?=[(\[{])(?&par) | ["'] )*+ [)\]}] )
)
"""
#: Comment before the declaration (ECMAScript and similar): comment, signature, balanced body. Bodies are
#: looked at, not passed over, so that functions within them are found.
LEADING = regex.compile(
    _FIRM
    + r"""
(?P<comment> /\*(?:[^*]|\*(?!/))*+\*/ | (?: [ \t]*//[^\n]*+\n )++ )
\s*+ (?P<signature> (?:@\w[^\n]*+\n\s*+)*+ (?: (?:export|default|async|public|private|protected|static|readonly|override|abstract|get|set)\s++ )*
    (?: function\s*+\*?\s*+ )? [*\#]?[\w$]++ \s*+ (?:<[^<>\n]*+>)? (?&par) (?: \s*+:\s*+ [^{};\n]++ )? )
\s*+ (?= (?P<body> (?&brc) ) )
""",
    regex.X,
)
#: Documentation string after the declaration or `#` lines before it (Python).
INNER = regex.compile(
    _FIRM_PYTHON
    + r"""
(?P<above> (?: [ \t]*+\#[^\n]*+\n )*+ )
(?P<indent> [ \t]*+ ) (?P<signature> (?:async\s++)? def\s++ \w++ \s*+ (?&par) (?: \s*+->\s*+ [^:\n]++ )? ) \s*+ :
[ \t]*+(?:\#[^\n]*+)? \n? (?P<comment> \s*+ [rRuU]? (?&str) )?+
(?= (?P<body> [^\n]*+ (?: \n (?: [ \t]*+ (?=\n|\Z) | (?P=indent)[ \t]++ [^\n]*+ ) )*+ ) )
""",
    regex.X | regex.M,
)
_COMMENT = r"(?P<comment> /\*(?:[^*]|\*(?!/))*+\*/ | (?: [ \t]*//[^\n]*\n )++ ) \s* "
#: Words that begin no declaration of a function by its type.
_NO_TYPE = r"(?!(?:return|else|if|for|while|switch|catch|new|throw|case|do|await|yield|function|const\s+\w+\s*=|let|var|func|def|class|interface|struct\s*\{|enum|namespace|typeof|delete|in|of|go|defer|try|finally|with|using|import|goto|sizeof)\b)"
#: Go functions and methods, functions kept in a variable (ECMAScript), functions headed by a type (C, Java and similar), shell functions.
#: Bodies are looked at, not passed over, so that functions within them are found.
DECLARED = tuple(
    regex.compile(_FIRM + pattern, regex.X)
    for pattern in (
        _COMMENT
        + r"""(?P<signature> func \s* (?: (?&par) \s* )? (?P<name> \w+ ) \s* (?&brk)? \s* (?&par) (?: [ \t]* (?: (?&par) | (?: (?:interface|struct)\{\} | [^{}()\n] | (?&par) )+? ) )? )
        [ \t]* (?= (?P<body> (?&brc) ) )""",
        _COMMENT
        + r"""(?P<signature> (?: (?:export|default|public|private|protected|static|readonly|declare)\s+ )* (?: (?:const|let|var)\s+ )? (?P<name> [\w$\#]+ ) (?: \s*[?!]?:\s* (?:[^=\n;]|=>)+? )? \s*=\s* (?:async\s*)?
            (?: function\s*\*?\s*[\w$]*\s* (?:<[^<>\n]*>)? (?&par) (?: \s*:\s* [^{};=\n]+ )? (?=\s*\{) | (?: (?:<[^<>\n]*>\s*)? (?&par) (?: \s*:\s* (?:[^{};=\n]|(?&brc))+? )? | [\w$]+ ) \s*=> ) )
        \s* (?= (?P<body> (?&brc) | (?> (?&com) | (?&str) | (?&par) | (?&brk) | (?&brc) | [^()\[\]{}"'`;\n] )++ ) )""",
        _COMMENT
        + r"""(?P<signature> (?: @\w[^\n]*\n\s* )* (?: """ + _NO_TYPE + r""" (?: [A-Za-z_][\w.:]*+ (?: <(?:[^<>{}();\n]|<[^<>{}();\n]*>)*> )? | <[^<>{}();\n]*> ) (?:\[\s*\])*+ [\s*&]++ )+ """ + _NO_TYPE + r"""
            (?P<name> ~?[A-Za-z_][\w:~]*+ ) \s* (?&par) (?: \s* (?: const\b | noexcept\b | override\b | final\b | throws\s+[\w., ]+ ) )* )
        \s* (?= (?P<body> (?&brc) ) )""",
        r"""(?P<comment> (?: (?<![^\n]) [ \t]*\#(?!!)[^\n]*\n )++ ) [ \t]* (?P<signature> (?: function[ \t]+ (?P<name> [\w:.-]+ ) (?: \s*\(\s*\) )? | (?P<name> [\w:.-]+ ) [ \t]*\(\s*\) ) )
        \s* (?= (?P<body> (?&shb) ) )""",
    )
)

#: What tools are told in comments, in any spelling. Fixed values.
_TOOLS = (
    r"pylint|noqa|flake8|mypy|pyright|ruff|isort|yapf|black|fmt|type|eslint|jshint|jslint|tslint|stylelint|prettier|biome|istanbul|c8|v8|"
    r"nyc|ts-ignore|ts-expect-error|ts-nocheck|ts-check|@ts-\w+|pragma|nolint|nosec|nosonar|noinspection|cspell|codespell|spellchecker|"
    r"coverage|clang-format|rubocop|phpcs|sonar|skipcq|webpack\w*|jest-environment|vite-ignore|global|globals|exported|bandit|nosemgrep|lint|"
    r"doctest|sourcery|pyre|pytype|region|endregion|deno|deno-lint-ignore|semgrep|lgtm|codeql|checkov|tfsec|swiftlint|ktlint|detekt|golint|golangci-lint"
)
_TOOL = re.compile(rf"^[@#\s]*(?:{_TOOLS})(?:$|\s*[:=\[(]|[-_ ]?(?:disable|enable|ignore|skip|off|on|no cover|no-cover)\b|-\w+)", re.I)
_TOOL_WORD = re.compile(r"^(?:noqa|nosec|nosonar|nolint|ts-ignore|ts-expect-error|skipcq|lgtm)\b", re.I)
#: Placeholders and reminders, and sentences that stand for "nothing is written here". Fixed values.
_REMINDER = re.compile(r"^\W*(?:todo|fixme|xxx+|hack|wip|tbd|tba|tbc|tk|n/?a|none|null|nil|bug|optimi[sz]e|later|pending|placeholder|lorem ipsum|foo|bar|baz|asdf|test|temp|stub|unused|work in progress|coming soon|to be (?:done|written|documented|defined|added|completed|determined|announced|filled))\b(?:\s*$|\W|(?<=ipsum)|(?<=done))", re.I)
_EMPTY_WORDS = frozenset(
    "this that the a an it please need needs missing add write insert fill in your some any no not un yet here is are has have been to be will for of and proper more better "
    "short brief long default generated auto automatically autogenerated by ide function functions method methods class module constructor procedure routine member code stub body "
    "doc docs docstring docstrings documentation documented document undocumented description descriptions describe comment comments commented summary available provided given "
    "written empty blank text goes placeholder template later soon tbd todo keine beschreibung fehlt dokumentation pas de aucune sin descripcion descripción documentacion documentación documenter dokumentieren noch nicht dokumentiert non documenté documentée documente documentee "
    "internal private public deprecated obsolete legacy override overrides overridden inherited inherit inheritdoc implements implementation note see".split()
)
_ELSEWHERE = re.compile(
    r"^\W*(?:see\b(?:\s+also)?|refer(?:s)?\s+to|cf\.?|same\s+as|as\s+above|ditto|idem\b|inherit(?:s|ed)?|overrid(?:e|es|den)|implements?\s|documented\s+(?:in|at|elsewhere|on)|copied\s+from|like\s+(?:above|the\s+(?:base|parent|super))|"
    r"docs?\s*:|link\s*:|https?://|siehe|vgl\.?|voir|v[eé]ase|ver\s|consulte[rz]?|described\s+(?:in|at)|(?:for\s+(?:details|more(?:\s+information)?|documentation),?\s+)?see\s)",
    re.I,
)
_TEXT_TAGS = "description|desc|summary|brief|short|remarks|remark|details|detail|note|overview|fileoverview|purpose|abstract|classdesc|function|method"
_SECTIONS = (
    r"args?|arguments?|param(?:eter)?s?|keyword\ arg(?:ument)?s|kwargs|attributes?|returns?|return\ value|yields?|raises?|throws?|exceptions?|examples?|usage|see\ also|references?|todo|other\ parameters|"
    r"inputs?|outputs?|requires|since|version|authors?|parameter|r[uü]ckgabe|param[eè]tres?|retourne?|par[aá]metros?|devuelve|retorna|rückgabewert"
)
#: A documented declaration: comment, signature and balanced body at once. The comment is read line by line as
#: grammar: marks of any kind of comment, empty lines, rules, tags and parameter sections with what hangs on them,
#: and in between the paragraphs of prose, each one capture of `para`. A signature that is no balanced declaration
#: is taken up to the body as it stands.
DOCUMENTED = regex.compile(
    _FIRM
    + r"""
(?(DEFINE)
  (?P<mark> (?= [/"'<\#*;%{(-] ) (?> /\*+!?+ | \"{3} | '{3} | <!-- | //++!?+ | \#++!?+ | \*++(?!\w) | --++(?=[ \t]*+[^\s-])(?!\w) | ;++ | %++ | \{- | \(\* ) [ \t\f\v]*+ )
  (?P<shut> \*++/ | / (?=[ \t]*+\n) | \"{3,} | '{3,} | --> | -\} | \*\) )
  (?P<nothing> (?: (?&shut) [ \t\f\v]*+ )*+ \n )
  (?P<rule> [-=~^*_\#]{2,}+ [ \t\f\v]*+ \n )
  (?P<tool> @++ [@\#\s]*+ (?i: """
    + _TOOLS
    + r""" ) (?: [ \t]*+(?=\n) | \s*+[:=\[(] | [-_ ]?(?:disable|enable|ignore|skip|off|on|no\ cover|no-cover)\b | -\w+ ) )
  (?P<text> (?= [@\\:] ) (?! (?&tool) ) (?i: [@\\] (?:"""
    + _TEXT_TAGS
    + r""")\b | :(?:"""
    + _TEXT_TAGS
    + r""")\b (?: \s++[^:\n]*+ )? : ) )
  (?P<tag> (?= [@\\:] ) (?! (?&text) | (?&tool) ) (?: [@\\] \w++ | :\w++ (?: \s++[^:\n]*+ )? : ) )
  (?P<head> (?i: """
    + _SECTIONS
    + r""" ) [ \t]*+ (?: : [ \t\f\v]*+ \n | :?+ [ \t\f\v]*+ \n (?= [ \t\f\v]*+ (?&mark){0,4}+ (?&rule) ) ) )
)
/\* \n (?P<comment> (?>
    (?P<para> (?: [ \t\f\v]++ (?: (?=[/"'<\#*;%{(-])(?&mark) ){0,4}+ (?=[@\\:])(?&text) (?: [^\n]*+ \n ) )?+ (?: [ \t\f\v]++ (?: (?=[/"'<\#*;%{(-])(?&mark) ){0,4}+ (?! (?=[*/"'\-}\n])(?&nothing) | (?=[-=~^*_\#])(?&rule) | (?=[A-Za-z][^\n]{1,24}+\n)(?&head) | (?=[@\\:])(?: (?&tag) | (?&text) ) ) [^\n]++ \n )++
        | [ \t\f\v]++ (?: (?=[/"'<\#*;%{(-])(?&mark) ){0,4}+ (?&text) [^\n]*+ \n )
  | [ \t\f\v]++ (?: (?=[/"'<\#*;%{(-])(?&mark) ){0,4}+ (?> (?&nothing) | (?&rule) | (?: (?&head) | (?&tag) [^\n]*+ \n ) (?: [ \t\f\v]++ (?: (?=[/"'<\#*;%{(-])(?&mark) ){0,4}+ (?! (?&nothing) | (?&text) ) [^\n]++ \n )*+ )
)*+ ) \*/ \n
(?P<signature> (?: (?! \n\{\}\n\Z ) (?> [^()\[\]{}"'`\n]++ | (?=["'`])(?&str) | (?=\()(?&par) | (?=\[)(?&brk) | (?=\{)(?&brc) | \n ) )++ (?= \n\{\}\n\Z ) | (?s:.)+? (?= \n\{\}\n\Z ) )
\n (?P<body> (?&brc) )
""",
    regex.X,
)
_MARK_OPEN = re.compile(r"^\s*(?:/\*+!?|\"{3}|'{3}|<!--|//+!?|#+!?|\*+(?!\w)|--+(?=\s*[^\s-])(?!\w)|;+|%+|\{-|\(\*)")
_MARK_CLOSE = re.compile(r"(?:\*+/|\"{3,}|'{3,}|-->|-\}|\*\))\s*$")
_TEXT_TAG = re.compile(rf"^\s*(?:[@\\](?:{_TEXT_TAGS})\b|:(?:{_TEXT_TAGS})\b(?:\s+[^:\n]*)?:)", re.I)
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|&#?\w+;|\{@\w+[^}]*\}|`{3,}\w*")
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_IDEOGRAPH = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
#: Words that add nothing to a symbol's own name. Fixed values.
_FILLER = frozenset(
    "a an the this that these those it its is are be do does did done function functions method methods func fn procedure routine member class object instance helper helpers util utility utilities "
    "constructor ctor initializer init of for to in on at by with from and or into as implementation implements implementing implement def definition define defines summary description doc docs "
    "documentation name named called call calls simply just which will should can used use uses using handler callback wrapper hook getter setter property value values main entry point default internal "
    "private public static async sync new given performs perform executes execute runs run operation action step logic code stuff thing things "
    "die der das eine ein funktion methode la le les une un fonction méthode el los las una función método de del".split()
)


def lay_out(doc: str, signature: str) -> str:
    """A declaration as source text: the documentation as a block comment, the signature, an empty body.

    Lines of the documentation are set in by one, so that none of them ends the comment.
    """
    lines = doc.replace("\r\n", "\n").replace("\r", "\n").replace("\n", "\n ")
    return f"/*\n {lines}\n*/\n{signature.strip()}\n{{}}\n"


def capture(doc: str, signature: str) -> tuple[str, list[str]]:
    """(signature, paragraphs of prose) captured together from the pair laid out as source text."""
    m = DOCUMENTED.match(lay_out(doc, signature))
    return m.group("signature").strip(), m.captures("para")


def _unmarked(line: str) -> str:
    for _ in range(4):
        new = _MARK_CLOSE.sub("", _MARK_OPEN.sub("", line))
        if new == line:
            break
        line = new
    return line


def sentences(paragraph: str) -> list[str]:
    """The sentences of a captured paragraph, without marks, markup and what is told to tools."""
    rows = []
    for line in paragraph.split("\n"):
        text = _MARKUP.sub(" ", _TEXT_TAG.sub("", _unmarked(line))).strip()
        if text and not (_TOOL.match(text) or _TOOL_WORD.match(text)):
            rows.append(text)
    return [s.strip() for s in _SENTENCE.split(" ".join(rows)) if s.strip()]


def prose(doc: str) -> list[str]:
    """The sentences of a documentation comment outside its marks, markup, tags and parameter sections."""
    return [s for paragraph in capture(doc, "f()")[1] for s in sentences(paragraph)]


def _stem(word: str) -> str:
    for end in ("ing", "es", "ed", "s", "e", "d"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


@lru_cache(maxsize=1 << 16)
def _word_parts(word: str) -> tuple[tuple[str, str], ...]:
    """(part in lower case, its stem) of every part of a word, `userId` being two."""
    return tuple((p.lower(), _stem(p.lower())) for p in _PARTS.findall(word))


def _parts(text: str) -> list[tuple[str, str]]:
    return [p for w in _WORDS.findall(text) for p in _word_parts(w)]


@lru_cache(maxsize=1 << 12)
def _name_parts(name: str) -> tuple[frozenset[str], str]:
    parts = _parts(name)
    return frozenset(stem for _, stem in parts), "".join(low for low, _ in parts)


def says_something(sentence: str, name: str) -> bool:
    """Whether one sentence tells about the code more than its name does."""
    parts = _parts(sentence)
    foreign = len(_IDEOGRAPH.findall(sentence)) >= 4 if not sentence.isascii() else False
    if len(parts) < 2 and not foreign:
        return False
    if _TOOL.match(sentence) or _TOOL_WORD.match(sentence) or _REMINDER.match(sentence) or _ELSEWHERE.match(sentence):
        return False
    if all(w in _EMPTY_WORDS for w in _WORDS.findall(sentence.lower())):
        return False
    own, glued = _name_parts(name)
    return foreign or any(low not in _FILLER and stem not in own and low != glued for low, stem in parts)


def description(paragraphs: list[str], name: str) -> str:
    """The telling sentences of the captured paragraphs, '' where there are none."""
    return " ".join(s for p in paragraphs for s in sentences(p) if says_something(s, name))


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, mark, name, signature, doc in zip(batch["id"], batch["mark"], batch["name"], batch["signature"], batch["docstring"]):
            sig, paragraphs = capture(doc, signature)
            said = description(paragraphs, name)
            if said:
                rows.append((key, mark, sig, said))
        yield pd.DataFrame(rows, columns=["id", "mark", "signature", "description"]).astype({"mark": "Int64"})


#: What a docstring must hold to say anything: two parts of words, or writing without spaces.
_SOME_PROSE = r"(?s)\p{L}[^\p{L}].*\p{L}|\p{L}\p{Lu}|\p{L}[^\p{L}\p{ASCII}]|[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0e7f]"


def documented_pairs(symbols: DataFrame) -> DataFrame:
    """(id, signature, description) of every documented function and method of code_symbols.

    Kinds count without case and outer spaces. Symbols with a null or blank signature or
    docstring, and those whose docstring holds no telling sentence, have no row; a symbol
    counts once however often delivered, a null name as the empty one. Rows without an id
    count each. Docstrings without two words don't leave the JVM.
    """
    kind = F.lower(F.trim("kind"))
    asked = kind.isin("function", "method") & F.col("signature").rlike(r"\S") & F.col("docstring").rlike(_SOME_PROSE)
    own = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    rows = symbols.filter(asked).select("id", own.alias("mark"), F.coalesce("name", F.lit("")).alias("name"), "signature", "docstring")
    said = rows.mapInPandas(_pairs, "id string, mark long, signature string, description string")
    return said.dropDuplicates(["id", "mark"]).drop("mark")


def with_bodies(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pairs with `code`: signature and balanced body captured from the chunk that holds the symbol.

    Of several chunks of a symbol the one of the lowest id counts; null where no chunk holds
    the signature, or not its whole body. Chunks without a symbol don't matter.
    """
    held = chunks.filter(F.col("symbol_id").isNotNull() & F.col("content").isNotNull() & F.col("chunk_type").isin("symbol", "symbol_header"))
    one = held.groupBy(F.col("symbol_id").alias("id")).agg(F.min_by("content", F.struct("id", "content")).alias("content"))
    joined = pairs.join(one, "id", "left")
    return joined.mapInPandas(_with_code, "id string, signature string, description string, code string")


#: The body that follows a signature: in braces, or set in below a colon.
_BRACED = regex.compile(_FIRM + r"\s*+ (?: (?:=>\s*+)? (?&brc) )", regex.X)
_INDENTED = regex.compile(r"(?P<indent>[ \t]*+)(?P<head>[^\n]*+)(?:\n(?:[ \t]*+(?=\n|\Z)|(?P=indent)[ \t]++[^\n]*+))++")


def code_of(content: str | None, signature: str) -> str | None:
    """Signature and body as they stand in a source text, None where they don't."""
    if not content:
        return None
    at = content.find(signature)
    if at < 0:
        return None
    end = at + len(signature)
    if content[end : end + 80].lstrip()[:1] == ":":
        m = _INDENTED.match(content, content.rfind("\n", 0, at) + 1)
        return content[at : m.end()] if m else None
    m = _BRACED.match(content, end)
    return content[at : m.end()] if m else None


def _with_code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        code = [code_of(text, sig) for text, sig in zip(batch["content"], batch["signature"])]
        yield batch[["id", "signature", "description"]].assign(code=pd.Series(code, dtype="object", index=batch.index))


def _found_in(text: str) -> list[tuple[int, str, str, str, str]]:
    """(place, signature, comment, name or '', body) of every declaration of a source text, by place."""
    found, heads = [], set()
    for pattern in (LEADING, INNER, *DECLARED):
        for m in pattern.finditer(text):
            if m.start("signature") in heads:
                continue
            heads.add(m.start("signature"))
            groups = m.groupdict()
            comment = groups["comment"] or groups.get("above") or ""
            found.append((m.start(), m.group("signature").strip(), comment, groups.get("name") or "", m.group("body")))
    return sorted(found)


def _from_source(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text in zip(batch["id"], batch["content"]):
            for at, sig, comment, name, body in _found_in(text):
                name = name or (re.search(r"([\w$]+)\s*(?:<[^<>]*>)?\s*\(", sig) or re.search(r"(\w+)", sig)).group(1)
                said = description(capture(comment, sig)[1], name)
                if said:
                    rows.append((key, text.count("\n", 0, at) + 1, sig, body.strip(), said))
        yield pd.DataFrame(rows, columns=["id", "line_no", "signature", "body", "description"])


def pairs_from_source(files: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(id, line_no, signature, body, description) captured from source texts themselves.

    Covered are ECMAScript functions, methods and functions kept in a variable, Python, Go,
    shell, and functions headed by their type as in C and Java; others give no row. Functions
    within functions count. Null and empty texts give no row; a text counts once however
    often delivered.
    """
    rows = files.select(F.col(key).cast("string").alias("id"), F.col(content).alias("content")).filter(F.col("content").rlike(r"(?:/\*|//|#|def )"))
    return once_by_id(rows).mapInPandas(_from_source, "id string, line_no int, signature string, body string, description string")
