"""Paths, identifiers and validators as Catalyst columns."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of chunk ids. A fixed value.
CHUNK_NAMESPACE = "2f4e1a2e-9d0b-4f0a-9a3b-6f8b2a1c4d55"


def normalise(path: Column) -> Column:
    """`.` and `..` resolved; a path that leaves the root starts with `..`."""
    fold = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc)
        .when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.array_append(acc, p)),
    )
    return F.array_join(fold, "/")


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def ancestors(path: Column) -> Column:
    """Every directory above, '' first."""
    parts = F.split(path, "/")
    inner = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("")), inner)


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct((acc.n + (acc.on & x).cast("int")).alias("n"), (acc.on & x).alias("on")), lambda acc: acc.n)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based version 5 UUID."""
    ns = uuid.UUID(namespace).hex
    h = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def repository_url(url: Column) -> Column:
    """struct(ok, owner, name, canonical_url) of a repository address on the code host."""
    u = F.trim(url)
    m = r"(?i)^https://(?:www\.)?github\.com(?::)?/+([^/]+)/([^/]+?)/*$"
    owner, raw = F.regexp_extract(u, m, 1), F.regexp_extract(u, m, 2)
    name = F.regexp_replace(raw, r"\.git$", "")
    ok = (
        u.rlike(r"^https://")
        & ~u.rlike(r"[\s\x00-\x1f\x7f%\\?#@]")
        & ~u.rlike(r"^https://[^/]*:")
        & (F.length(u) <= 2048)
        & owner.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}$")
        & name.rlike(r"^[A-Za-z0-9._-]{1,100}$")
        & ~name.isin(".", "..")
    )
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, owner).alias("owner"), F.when(ok, name).alias("name"), F.when(ok, F.lower(F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name))).alias("canonical_url"))


def branch_ok(branch: Column) -> Column:
    """Git's rules for a branch name, and a list of allowed characters."""
    b = F.trim(branch)
    bad = (
        ~b.rlike(r"^[A-Za-z0-9._/+#@-]{1,255}$")
        | b.rlike(r"^[-/]|[/.]$|\.lock$|\.\.|//|@\{|(?:^|/)\.")
        | (b == "@")
    )
    return F.coalesce(~bad, F.lit(False))


def relative_path_ok(path: Column) -> Column:
    """Not empty, at most 1024 characters, not absolute, without NUL, backslash, `.` or `..` parts."""
    return F.coalesce((F.length(path).between(1, 1024)) & ~path.rlike(r"^/|[\x00\\]") & ~path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.lit(False))


def sha_ok(sha: Column) -> Column:
    return F.coalesce(sha.rlike(r"^[0-9a-f]{40}(?:[0-9a-f]{24})?$"), F.lit(False))


def git_failure(stderr: Column) -> Column:
    """branch_not_found, not_found, network or failed, in this order of tests."""
    # fixed values: what git and its transport say
    t = F.lower(stderr)
    any_of = lambda *marks: t.rlike("|".join(marks))
    return (
        F.when(F.contains(t, F.lit("remote branch")) & F.contains(t, F.lit("not found")), "branch_not_found")
        .when(any_of("repository not found", "could not read username", "authentication failed", "terminal prompts disabled", "does not appear to be a git repository", "not a git repository", "returned error: 404", "returned error: 403"), "not_found")
        .when(any_of("could not resolve host", "failed to connect", "connection timed out", "network is unreachable", "connection refused", "operation too slow", "unable to access"), "network")
        .otherwise("failed")
    )


def hashing_embedding(tokens: list[str], size: int = 256) -> list[float]:
    """Signed feature hashing of tokens into a unit vector."""
    v = [0.0] * size
    for t, n in Counter(tokens).items():
        d = hashlib.blake2b(t.encode(), digest_size=8).digest()
        v[int.from_bytes(d[:4], "big") % size] += n if d[4] & 1 else -n
    norm = max(sum(x * x for x in v) ** 0.5, 1e-12)
    return [x / norm for x in v]
