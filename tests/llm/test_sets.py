"""Operators over the whole collection: near duplicates, provenance, packing, mixing, reading level."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from codelode.llm import mixing, neardup, packing, provenance, reading

TERM = re.compile(r"[A-Za-z0-9_]+")


def triples(text):
    w = [x.lower() for x in TERM.findall(text or "") if 2 <= len(x) <= 40 and not x[0].isdigit()]
    return set(zip(w, w[1:], w[2:]))


def edited(rng, words):
    out = list(words)
    for _ in range(rng.randrange(6)):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = [f"new{rng.randrange(99)}"]
    return " ".join(out)


def near_texts():
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 160))]
        texts += [edited(rng, words) for _ in range(rng.randrange(1, 7))]
    texts += ["; ".join(texts[0].split())] * 5  # the same triples laid out anew, a hot group
    return texts + ["", None, "ab cd ef", "q" * 5000]


def test_pairs_and_groups_against_brute_force(spark):
    texts = near_texts()
    rows = [(f"c{i:03d}", t, f"q{i}", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:7] + [(None, texts[0], "q", 1)], "id string, content string, qualified_name string, n int").repartition(3)
    sets = {i: s for i, t, *_ in rows if len(s := triples(t)) >= 30}
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    got = [(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    groups = {r["id"]: r for r in neardup.near_duplicate_groups(df).collect()}
    assert set(groups) == set(sets)
    for a, b in want:
        assert groups[a]["group_id"] == groups[b]["group_id"]
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert {i: r["group_id"] for i, r in groups.items()} == root
    for i, r in groups.items():
        others = {groups[x]["class"] for p in want if i in p for x in p} - {r["class"]}
        assert r["links"] == len(others)


def test_pairs_with_hot_and_salted_triples(spark, monkeypatch):
    """No link is lost where every bucket of the sketch is hot, or where each triple is split by salt."""
    base = [f"w{k}" for k in range(50)]
    texts = [" ".join([*base, *(f"own{i}x{k}" for k in range(i))]) for i in range(14)] + [" ".join(f"z{i}q{k}" for k in range(40)) for i in range(3)]
    df = spark.createDataFrame([(f"c{i:02d}", t) for i, t in enumerate(texts)], "id string, content string").repartition(3)
    sets = {f"c{i:02d}": triples(t) for i, t in enumerate(texts)}
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    for name, value in (("SALT", 2), ("HOT", 0)):
        monkeypatch.setattr(neardup, name, value)
        assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == want and want
    assert neardup.sketch_bits(8) == 16 and neardup.sketch_bits(100_000) == 20 and neardup.sketch_bits(10**9) == 22


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "id string, content string")
    assert neardup.similar_pairs(df).count() == 0 and neardup.near_duplicate_groups(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("y", "x")], "a string, b string")
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert len(got) == 63 and {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["y"] == "x"


# ---- 6: provenance

FOREIGN = {
    "web/node_modules/lib/a.js": (900, 40), "src/vendor/lib/b.go": (900, 40), "api/x_pb2.py": (900, 40), "app/yarn.lock": (900, 40), "public/main.4171b1cc.js": (90_000, 1), "lib/assets/zip-1.4.0.css": (900, 40), "dist/z.js": (900, 40),
    "src/marked.go": (900, 40), "src/table.py": (90_000, 1500), "static/plain.js": (200_000, 2), "x/__snapshots__/a.snap": (100, 9), ".\\third_party\\q\\c.c": (900, 40), "static/app.js.map": (9000, 1),
}
OWN = {"src/a.py": (900, 40), "vendors/b.py": (900, 40), "src/min_order.ts": (900, 40), "src/generate_it.py": (900, 40), "docs/big.csv": (900_000, 9000), "external_auth/c.js": (900, 40), "src/writes.py": (900, 40), "distribution/d.ts": (900, 40), "conf/x.json": (90_000, 2), "README": (10, 1), "src/long.c": (60_000, 2_600)}


def test_provenance(spark):
    rows = [(f"f{i}", "r", p, None, *s, "h") for i, (p, s) in enumerate([*FOREIGN.items(), *OWN.items()])]
    rows += rows[:3] + [(None, None, None, None, None, None, None)]
    files = spark.createDataFrame(rows, "id string, repository_id string, path string, language string, size_bytes long, line_count int, content_sha256 string")
    code = spark.createDataFrame([("r", "src/a.py", 4, 1)], "repository_id string, path string, symbol_count int, import_count int")
    marks = [("r", "src/marked.go", "// Code generated by stub. DO NOT EDIT.\npackage x\n"), ("r", "src/writes.py", 'def f():\n    out.write("# AUTO-GENERATED FILE - do not edit")\n'), ("r", "src/table.py", "x = [\n" + "    0.123, 4.567, 8.9,\n" * 40), ("r", "src/a.py", None)]
    chunks = spark.createDataFrame(marks, "repository_id string, file_path string, content string")
    got = {r["id"]: r["label"] for r in provenance.label_files(files, code, chunks).collect()}
    names = {f"f{i}": p for i, p in enumerate([*FOREIGN, *OWN])}
    assert {names[i] for i in got if i and got[i] != "handwritten"} == set(FOREIGN)
    assert len(got) == len(names) + 1
    assert provenance.label_files(files.limit(0), code, chunks).count() == 0


def brute_beliefs(files):
    """Label odds of every file by walking the trees: files are (id, dir, evidence)."""
    dirs = {""}
    for _, d, _ in files:
        parts = d.split("/") if d else []
        dirs |= {"/".join(parts[:n]) for n in range(1, len(parts) + 1)}
    up_of = lambda d: d.rsplit("/", 1)[0] if "/" in d else ""
    c = np.array(provenance.COMPATIBILITY)
    up = lambda logs: np.log(c @ np.exp(logs - logs.max()))
    own = {}
    for d in dirs:
        name = d.rsplit("/", 1)[-1].lower()
        row = (1e-4, 1e-3, 1e-3, 1.0, 1e-3) if name in provenance.VENDOR_DIRS else (1e-4, 1.0, 0.01, 1e-3, 1e-3) if name in provenance.BUILD_DIRS else (1e-4, 1.0, 1e-3, 1e-3, 1e-3) if name in provenance.GENERATED_DIRS else None
        own[d] = (np.zeros(5) if row is None else np.log(row), row is not None)
    told, weight = {}, {}

    def gather(d):
        heard = [up(e) for _, at, e in files if at == d]
        for child in sorted(dirs - {""}):
            if up_of(child) == d:
                gather(child)
                if not own[child][1]:
                    heard.append(told[child][1])
        weight[d] = provenance.SIBLING * min(1.0, provenance.WITNESSES / len(heard)) if heard else 0.0
        logs = own[d][0] + weight[d] * sum(heard, np.zeros(5))
        told[d] = (logs, up(logs))

    gather("")
    down = lambda above, sent: np.log(c.T @ np.exp(above - sent - (above - sent).max()))
    believed = {"": told[""][0] + np.log(provenance.ROOT_PRIOR)}
    for d in sorted(dirs - {""}, key=lambda d: d.count("/")):
        sent = np.zeros(5) if own[d][1] else told[d][1] * weight[up_of(d)]
        believed[d] = told[d][0] + down(believed[up_of(d)], sent)
    out = {}
    for i, d, e in files:
        b = np.exp((b := e + down(believed[d], up(e) * weight[d])) - b.max())
        out[i] = 1.0 - b[0] / b.sum()
    return out


def test_propagation_is_exact(spark):
    """The messages equal a walk over the tree, and they, not the files alone, name what lies in a vendor folder."""
    r = random.Random(5)
    paths = [f"{r.choice(['a', 'a/b', 'a/b/c', '', 'a/vendor/q', 'a/vendor/q/lib', 'gen/generated', 'w'])}/f{i}.{r.choice(['py', 'md', 'min.js', 'go', 'lock'])}" for i in range(60)]
    files = spark.createDataFrame([(str(i), "r", p, r.choice([None, 500, 90_000]), r.choice([None, 20])) for i, p in enumerate(paths)], "id string, repository_id string, path string, size_bytes long, line_count int")
    code = spark.createDataFrame([], "repository_id string, path string, symbol_count int")
    chunks = spark.createDataFrame([], "repository_id string, file_path string, content string")
    evidence = [(x["id"], x["dir"], np.array(x["e"])) for x in provenance.file_evidence(files, code, chunks).collect()]
    want = brute_beliefs(evidence)
    got = {x["id"]: x["doubt"] for x in provenance.label_files(files, code, chunks).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    alone = {x["id"]: x["label"] for x in provenance.label_files(files, code, chunks, propagate=False).collect()}
    within = [str(i) for i, p in enumerate(paths) if "vendor" in p and p.endswith("md")]
    assert within and all(alone[i] == "handwritten" and got[i] > 0.5 for i in within)


def test_siblings_tell(spark):
    """A plain file among nine copies with a licence mark is a copy too; among nine plain files it is not."""
    plain = [("x", "r", "kept/lib/zed.js", 900, 40), ("y", "r", "own/lib/zed.js", 900, 40)]
    rows = plain + [(f"{d}{i}", "r", f"{d}/lib/f{i}.js", 900, 40) for d in ("kept", "own") for i in range(9)]
    files = spark.createDataFrame(rows, "id string, repository_id string, path string, size_bytes long, line_count int")
    chunks = spark.createDataFrame([("r", f"kept/lib/f{i}.js", "/*! zed v1.2.3 | MIT license */\nx()\n") for i in range(9)], "repository_id string, file_path string, content string")
    code = spark.createDataFrame([], "repository_id string, path string, symbol_count int")
    got = {x["id"]: x["label"] for x in provenance.label_files(files, code, chunks).collect()}
    assert got["x"] == "vendored" and got["y"] == "handwritten" and got["own3"] == "handwritten" and got["kept3"] == "vendored"


# ---- 7: packing


def brute_rounds(sizes, capacity):
    """(containers, gaps) of the rounds done in one sequence: the piece on hand takes the gap on top."""
    pieces, gaps = sorted(sizes, reverse=True), {}
    while pieces:
        widest = max(gaps.values(), default=0)
        n = max(-(-(sum(pieces) - sum(gaps.values())) // capacity), -(-sum(p for p in pieces if p > widest) // capacity), 0)
        for _ in range(n):
            gaps[len(gaps)] = capacity
        rows = sorted([(-w, 0, c) for c, w in gaps.items() if w] + [(-p, 1, k) for k, p in enumerate(pieces)])
        stack, missed = [], []
        for size, kind, which in rows:
            if kind == 0:
                stack.append([which, max(-size // pieces[0], 1)])
            elif stack:
                gaps[stack[-1][0]] += size
                stack[-1][1] -= 1
                if not stack[-1][1]:
                    stack.pop()
            else:
                missed.append(-size)
        pieces = missed
    return len(gaps), sorted(gaps.values())


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_one_sequence(spark, seed):
    """However the rows lie in partitions, the containers are those of the rounds done in sequence."""
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 101), rng.randrange(1, 12), 7]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long").repartition(7)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many partitions as can be
    got = packing.pack_sizes(df, [(1, 100)]).toPandas()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    used = got.groupby("container").tokens.sum()
    n, gaps = brute_rounds(sizes, 100)
    assert len(got) == 400 and used.max() <= 100 and sorted(used.index) == list(range(n))
    assert sorted((100 - used).tolist()) == gaps


def test_meeting_by_rank():
    """Pieces left over meet the gaps of partitions before them, the nearest and last first."""
    assert packing.meet_by_rank([(1, 0, 0, 2), (1, 1, 1, 3), (1, 2, 6, 0), (2, 0, 1, 1), (2, 1, 2, 0)]) == [(1, 1, 0, 0, 1, 1), (1, 2, 0, 1, 2, 3), (1, 2, 3, 0, 0, 1), (2, 1, 0, 0, 0, 1)]


def test_packed_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 900)) for i in range(500)] + [(900 + i, 77) for i in range(300)] + [(9999, 0), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").repartition(5)
    got = packing.pack_sizes(df, [(1, 256), (2, 1000), (3, None), (4, 0)]).toPandas()
    for spec, capacity in ((1, 256), (2, 1000)):
        mine = got[got.spec_id == spec]
        assert mine.groupby("container").tokens.sum().max() <= capacity
        assert mine.groupby("doc_id").tokens.sum().to_dict() == {d: t for d, t in rows if t and d is not None}
        assert mine.container.nunique() == mine.container.max() + 1 <= 1.03 * mine.tokens.sum() / capacity + 1
        assert ((mine.parts > 1) == (mine.doc_id.map(dict(rows)) > capacity)).all()
    assert packing.pack_sizes(df.limit(0), [(1, 256)]).count() == 0


def test_pack_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 600, 3), (2, "", 3), (3, None, 3), (4, "a b", 3), (5, "a b", 3)], "doc_id long, text string, tokens int")
    specs = spark.createDataFrame([(1, 256), (1, 256)], "spec_id int, capacity_tokens int")
    got = packing.pack_documents(docs, specs).toPandas()
    assert sorted(got[got.doc_id == 1].first_token) == [0, 256, 512] and set(got.doc_id) == {1, 4, 5}
    assert packing.container_fill(packing.pack_documents(docs, specs)).collect()[0]["containers"] == 3


# ---- 8: mixing


def test_shares(spark):
    rng = random.Random(9)
    rows = [(i, " A " if i % 3 else "b", "tok " * rng.randrange(1, 60), 1) for i in range(600)] + [(700, "b", None, 1), (701, None, "x y", 1), (702, "c", "x y", 1), (703, "b", "big " * 3000, 1), (None, "b", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int").repartition(4)
    targets = spark.createDataFrame([("a", 0.3, 1), ("B ", 0.6, 4), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.mixture_shares(docs, targets).collect()}
    assert got["a"]["share"] == pytest.approx(1 / 3, abs=0.003) and got["b"]["share"] == pytest.approx(2 / 3, abs=0.003) and got["gone"]["copies"] == 0
    assert got["a"]["most_copies"] <= 1 and got["b"]["most_copies"] <= 4
    mixed = mixing.mix_sources(docs, targets).toPandas()
    again = mixing.mix_sources(docs, targets).toPandas()
    assert mixed.doc_id.is_unique and set(mixed.source) == {"a", "b"}
    assert sorted(map(tuple, mixed.values)) == sorted(map(tuple, again.values))
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0 and mixing.mix_sources(docs, targets.limit(0)).count() == 0


def test_pivot_keeps_mass_and_expectation():
    total = Counter()
    for seed in range(400):
        settled, left = mixing.pivot([(1, 10, 0, 0.3), (2, 10, 1, 0.5), (3, 10, 0, 0.7)], 0, seed)
        assert len(settled) >= 2 and len(left) <= 1 and 10 * sum(w for _, _, w in settled) + 10 * sum(w + p for _, _, w, p in left) == pytest.approx(25)
        for d, _, w in settled:
            total[d] += w
        for d, _, w, p in left:
            total[d] += w + p
    assert total[1] / 400 == pytest.approx(0.3, abs=0.08) and total[2] / 400 == pytest.approx(1.5, abs=0.08)


def test_a_lonely_record_is_settled_against_all_others():
    """One record outweighs any other by far: its mass goes to and comes from all of them, and the source keeps its tokens."""
    records = [(0, 9000, 0, 0.4)] + [(i, 20 + i % 30, 0, 0.4) for i in range(1, 900)]
    records.sort(key=lambda r: (-r[1], r[0]))
    whole = 0.4 * sum(t for _, t, _, _ in records)
    ups = 0
    for seed in range(60):
        settled, left = mixing.pivot(records, 0, seed)
        assert sum(t * w for _, t, w in settled) + sum(t * (w + p) for _, t, w, p in left) == pytest.approx(whole)
        assert len(left) <= 1 and all(t < 200 for _, t, _, _ in left)
        ups += dict((d, w) for d, _, w in settled)[0]
    assert 10 < ups < 40
    settled, left = mixing.pivot(records, 500, 1)
    assert len(left) in (500, 501) and 0 in {d for d, _, _ in settled}


# ---- 9: reading level

EASY = "See the log. The box is red. Did you read the map? Keep the key."
HARD = "Whereas the conventional operationalization of heterogeneous dependencies, which presumes an undifferentiated taxonomy, precludes reconciliation, the epistemological reconstruction advocated here, notwithstanding its provisional character, necessitates the retrospective disambiguation of those abstractions upon which the subsequent interpretation depends."
MIDDLE = "When a commit is external, the chunk returns the package and writes a note to the log."


def levels(spark, texts):
    rng = random.Random(4)
    fill = "page tree map key log box job line word step team file list tool bug code".split()
    long = "methodology interoperability canonicalization heterogeneity instrumentation decomposition extensibility observability".split()
    rows, graded = [], []
    for i in range(90):
        g = (1, 3, 5)[i % 3]
        base = {1: f"See the {rng.choice(fill)}. The {rng.choice(fill)} is red. Keep the {rng.choice(fill)}.", 3: MIDDLE.replace("commit", rng.choice(fill)), 5: HARD.replace("reconciliation", rng.choice(long))}[g]
        rows.append((1000 + i, base, "x"))
        graded.append((1000 + i, "r", g))
    docs = spark.createDataFrame(rows + [(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, level string")
    labels = spark.createDataFrame(graded + [(1000, "s", None), (5, "s", None), (77777, "r", 2)], "doc_id long, rater string, grade int")
    return {r["doc_id"]: r for r in reading.reading_levels(docs, labels).collect()}


def test_levels(spark):
    german = "Die Tabelle öffnet die Prüfung, sobald die Abfrage mit der Datei fertig ist und das Ergebnis nicht mehr auf sich warten lässt."
    code = "```\n" + HARD + "\n```\n\n" + EASY
    plain_long = "We looked at the log and the box and the key and the map, and then we did read the page, and then the line, and in the end the job was as short as it had been at the start."
    got = levels(spark, [EASY, HARD, MIDDLE, german, code, "", None, EASY * 30 + " " + HARD, "- " + HARD, "x" * 100_000, plain_long, HARD + " " + HARD])
    assert got[1]["grade"] == 5 and got[11]["grade"] == 5 and got[0]["grade"] <= 2
    assert all(got[i]["grade"] != 5 for i in (2, 4, 7, 10)) and got[0]["level"] < got[2]["level"] < got[1]["level"]
    assert got[3]["language"] == "de" and all(got[i]["grade"] is None for i in (3, 5, 6, 8))
    assert len(got) == 102


def test_levels_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, HARD)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, grade int")
    assert reading.reading_levels(docs, labels).count() == 1 and reading.reading_levels(docs.limit(0), labels).count() == 0
