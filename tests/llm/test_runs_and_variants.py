"""Periodic runs and spelling variants against brute force, and on awkward tables."""

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest

from conftest_llm import docs_of
from tickloom.llm import periodic, queries, variants

FOLDER = "/root/testdata/sf0.001"


# periodic runs


def runs_of(w, least=12):
    """All maximal stretches, period by period; the first period that finds a stretch is its smallest."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                out.setdefault((s - q, i - 1), q)
    return sorted(((s, e - s + 1, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def test_runs_match_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            k = rng.randint(1, 5)
            w = rng.choices(range(k), k=rng.randint(0, 60))
            for _ in range(rng.randint(0, 3)):
                b = rng.choices(range(k + 1), k=rng.randint(1, 70))
                w += b * rng.randint(1, 8) + b[: rng.randrange(len(b))]
                w += w if rng.random() < 0.3 else []
                w[rng.randrange(len(w))] = 9 if rng.random() < 0.3 else w[0]
            docs.append(w[:1200])
        ends = np.cumsum([0, *map(len, docs)])
        found = [[] for _ in docs]
        for s, e, q in zip(*(x.tolist() for x in periodic.find_runs(np.array(sum(docs, []), np.int64), ends))):
            k = int(np.searchsorted(ends, s, "right")) - 1
            found[k].append((s - ends[k], e - s + 1, q))
        assert found == [runs_of(d) for d in docs]


@pytest.mark.parametrize("parts", [[(1, 300_000)], [(1, 60_000), (2, 1), (1, 60_000)], [(15, 4_000), (1, 1), (15, 4_000)]])
def test_long_repetition_is_no_quadratic_work(parts):
    codes = np.concatenate([np.tile(np.arange(p) + 7 * p, n) for p, n in parts])
    start, last, period = periodic.find_runs(codes, np.array([0, len(codes)]))
    assert period[0] == parts[0][0] and (start[0], last[0]) == (0, parts[0][0] * parts[0][1] - 1)
    assert (last - start + 1 >= 2 * period).all()


def test_runs_of_the_query_match_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op12_periodic(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs)
    several = 0
    for d in docs:
        w = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, r = runs_of(w), rows[d.doc_id]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest()
        several += len(runs) > 0
    assert several > 10


def test_collapse_takes_awkward_tables(spark, awkward, nothing):
    out = periodic.collapse(awkward.withColumnRenamed("text", "_key"), "doc_id", "kept", "size", text="_key")
    assert out.columns == ["doc_id", "kept", "size", "runs", "collapsed"] and out.count() == awkward.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].runs == [] and rows[2].collapsed == rows[3].collapsed == rows[4].collapsed == ""
    assert [tuple(r) for r in rows[6].runs] == [(0, 30_000, 1)] and rows[6].collapsed == "word"
    assert rows[5].collapsed == "x" * 70_000 and rows[None].collapsed == "one two"
    digest = periodic.digest(periodic.collapse(awkward, "doc_id", "kept"), "doc_id", "kept")
    assert {(r.n_runs, r.start) for r in digest.collect()} == {(0, None), (1, 0)}
    assert periodic.collapse(nothing, "doc_id").collect() == []
    assert spark.createDataFrame([(None, "a b " * 50)], "id long, t string").select(periodic.planted("t", "id").alias("x")).first().x == "a b " * 50


# spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=10):
    """{word: (form, root, n, n_near, form_n)} by all pairs."""
    close = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w) + 1):
            close[w[:i] + "\0" + w[i:]].add(w)
            if i < len(w):
                close[w[:i] + "\0" + w[i + 1 :]].add(w)
    out, forms = {}, {}
    for w, n in counts.items():
        keys = {w[:i] + "\0" + w[i:] for i in range(len(w) + 1)} | {w[:i] + "\0" + w[i + 1 :] for i in range(len(w))}
        found = [v for v in set().union(*(close[k] for k in keys)) if near(w, v)]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(found))
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, *out[w], counts[forms[w]] if forms[w] else None)
    return out


def test_index_block_matches_all_pairs():
    rng = random.Random(5)
    for size in (1, 2, 63, 64, 65, 150):
        v = sorted({"".join(rng.choices("abç", k=rng.randint(1, 6))) for _ in range(size)})
        query, found = variants.index_block(v)
        assert sorted(zip(query.tolist(), found.tolist())) == [(i, j) for i, a in enumerate(v) for j, b in enumerate(v) if near(a, b)]


@pytest.mark.parametrize("most", [4096, 20])
def test_groups_match_all_pairs(spark, most):
    """Also with groups so small that thirds are halved to single letters."""
    rng = random.Random(6)
    counts = {"".join(rng.choices("aeiou", k=rng.randint(1, 9))): rng.choice([1, 2, 15, 30, 400, 5000]) for _ in range(1500)}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    want = {(a, b) for a in counts for b in counts if near(a, b)}
    got = variants.links(vocabulary, most=most).collect()
    assert len(got) == len(want) and {(r.word, r.other) for r in got} == want
    assert all((r.n, r.other_n) == (counts[r.word], counts[r.other]) for r in got)


def test_chains_reach_their_root(spark):
    counts = {"abcdefg": 100_000, "abcdefgh": 10_000, "abcdefghi": 1_000, "abcdefghij": 100, "abcdefghijk": 10, "abcdefghijkl": 1, "bcdefghij": 999}
    rows = variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == grouped(counts)
    assert {r.root for r in rows if r.word != "bcdefghij"} == {"abcdefg"}


def test_variants_of_the_query_match_brute_force(spark):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    counts = collections.Counter()
    for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{d.doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    rows = queries.op13_variants(spark, FOLDER).collect()
    want = grouped({w: n for w, n in counts.items() if n >= 2})
    assert len(rows) == len(want) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want
    assert sum(r.form is not None for r in rows) > 5


def test_variants_take_awkward_tables(spark, awkward, nothing):
    counts = {r.word: r.n for r in variants.count_words(awkward, least_letters=4, slips="doc_id").collect()}
    assert counts["word"] + counts.get("wrd", 0) == 30_000 and counts["x" * 70_000] == 1 and counts["sentence"] >= 2
    assert variants.group_variants(variants.count_words(nothing)).collect() == []
    rows = variants.group_variants(variants.count_words(awkward.withColumnRenamed("text", "word"), text="word", least_letters=1)).collect()
    assert len(rows) == len({r.word for r in rows}) and all(r.form_n is None or r.form_n >= 10 * r.n for r in rows)
    tied = spark.createDataFrame([("aaaaaab", 50), ("aaaaaac", 50), ("aaaaaad", 5)], "word string, n long")
    assert {r.word: r.form for r in variants.group_variants(tied).collect()} == {"aaaaaab": None, "aaaaaac": None, "aaaaaad": "aaaaaab"}
    assert docs_of(spark, []).count() == 0
