"""File classification: language, manifests, ignored directories."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language, grouped by language.
_EXTENSIONS = {
    "Python": (".py", ".pyi"),
    "Jupyter Notebook": (".ipynb",),
    "JavaScript": (".js", ".mjs", ".cjs", ".jsx"),
    "TypeScript": (".ts", ".mts", ".cts", ".tsx"),
    "Java": (".java",),
    "Kotlin": (".kt", ".kts"),
    "Scala": (".scala",),
    "Groovy": (".groovy",),
    "Go": (".go",),
    "Rust": (".rs",),
    "C": (".c", ".h"),
    "C++": (".cc", ".cpp", ".cxx", ".hpp", ".hh"),
    "C#": (".cs",),
    "F#": (".fs",),
    "Swift": (".swift",),
    "Objective-C": (".m", ".mm"),
    "Ruby": (".rb",),
    "PHP": (".php",),
    "Perl": (".pl",),
    "Lua": (".lua",),
    "R": (".r",),
    "Julia": (".jl",),
    "Dart": (".dart",),
    "Elixir": (".ex", ".exs"),
    "Erlang": (".erl",),
    "Haskell": (".hs",),
    "Clojure": (".clj",),
    "OCaml": (".ml",),
    "Zig": (".zig",),
    "Solidity": (".sol",),
    "Shell": (".sh", ".bash", ".zsh"),
    "PowerShell": (".ps1",),
    "SQL": (".sql",),
    "HTML": (".html", ".htm"),
    "CSS": (".css",),
    "SCSS": (".scss",),
    "Sass": (".sass",),
    "Less": (".less",),
    "Vue": (".vue",),
    "Svelte": (".svelte",),
    "JSON": (".json",),
    "YAML": (".yaml", ".yml"),
    "TOML": (".toml",),
    "XML": (".xml",),
    "INI": (".ini",),
    "Protocol Buffers": (".proto",),
    "GraphQL": (".graphql", ".gql"),
    "Markdown": (".md",),
    "MDX": (".mdx",),
    "reStructuredText": (".rst",),
    "TeX": (".tex",),
}
# Languages told by the whole file name.
_FILENAMES = {"Dockerfile": "Dockerfile", "Makefile": "Makefile", "CMakeLists.txt": "CMake", "Jenkinsfile": "Groovy"}
#: Languages that are no programming languages. Fixed values.
NON_PROGRAMMING = ("JSON", "YAML", "TOML", "XML", "INI", "Markdown", "MDX", "reStructuredText", "TeX")
#: Directories no scan enters. Fixed values.
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox",
    ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache", "dist", "build", "out", "target", "coverage", ".gradle", ".idea", ".vscode", ".terraform",
)
#: Files that describe what a project is built of. Fixed values.
MANIFESTS = (
    "package.json", "pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile", "poetry.lock", "go.mod", "Cargo.toml", "pom.xml", "build.gradle",
    "build.gradle.kts", "Gemfile", "composer.json", "mix.exs", "pubspec.yaml", "Package.swift", "CMakeLists.txt", "Makefile", "Dockerfile", "docker-compose.yml",
)
#: What a top-level file of these kinds begins with, in any case. Fixed values.
README_PREFIXES = ("readme",)
LICENSE_PREFIXES = ("license", "licence", "copying")
#: Lock files, which are not cut into chunks. Fixed values.
LOCK_NAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Cargo.lock", "composer.lock", "Gemfile.lock", "go.sum",
)
#: Files cut at their headings. Fixed values.
MARKDOWN_SUFFIX = r"(?i)\.(?:md|mdx|markdown|rst)$"

EXTENSION_LANGUAGE = {e: lang for lang, all_ in _EXTENSIONS.items() for e in all_}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column) -> Column:
    """Exact file name first, else the last extension in any case; null for dotfiles and unknown ones."""
    name = file_name(path)
    extension = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    return F.coalesce(_lookup(_FILENAMES, name), _lookup(EXTENSION_LANGUAGE, extension))


def ignored(path: Column) -> Column:
    """Whether a directory above the file is one of dependencies, output or caches."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, IGNORED_DIRECTORIES)))


def worth_chunking(path: Column, language: Column) -> Column:
    """No lock file, no JSON or CSV; of known language or Markdown."""
    keep = language.isNotNull() | path.rlike(MARKDOWN_SUFFIX)
    return keep & ~file_name(path).isin(*LOCK_NAMES) & ~F.coalesce(language.isin("JSON", "CSV"), F.lit(False))


def analyzer_of(path: Column) -> Column:
    """Parser that takes the file, null for none and for minified or bundled scripts."""
    low = F.lower(path)
    by = {".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx"}
    return F.when(~low.rlike(r"\.(?:min\.js|min\.mjs|bundle\.js|chunk\.js)$"), _lookup(by, F.regexp_extract(low, r"(\.[^./]+)$", 1)))
