"""What operators send must follow the input, whatever its texts share."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from conftest_llm import docs_of

from tickloom.llm import jaccard, secrets


def test_sets_that_share_a_frequent_passage_alone_are_never_sent_whole(spark, prose, monkeypatch):
    """Before sketches, every set of a tree travelled with all its shingles."""
    sent, whole = [], jaccard.contents
    monkeypatch.setattr(jaccard, "contents", lambda docs, wanted, *a: sent.append({r.set for r in wanted.collect()}) or whole(docs, wanted, *a))
    passage = prose(13, 5)
    texts = [f"{prose(40 + k, 100 + k)} {passage}" for k in range(60)]
    texts += [" ".join(["other", *t.split()[1:]]) for t in texts[:3]]
    keys = {r.doc_id: r for r in jaccard.set_keys(docs_of(spark, texts), "doc_id", shingle=5).collect()}
    rows = jaccard.subtrees(docs_of(spark, texts), shingle=5, percent=80).collect()
    met = Counter(r.sig for r in rows)
    assert len({r.set for r in rows if met[r.sig] > 1}) > 12
    got = {r.doc_id: r.component_id for r in jaccard.join(docs_of(spark, texts), "doc_id", shingle=5, percent=80).collect()}
    assert got == {i: i - 60 if i >= 60 else i for i in range(63)}
    assert sent == [{keys[i]._set for i in (0, 1, 2, 60, 61, 62)}]


@pytest.mark.parametrize("percent", [30, 60, 80, 95])
def test_sketches_part_no_linked_sets(percent, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    monkeypatch.setattr(jaccard, "WORDS", 64)
    rng = np.random.default_rng(percent)
    fresh = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    sets, block = [], []
    for k in range(4):
        base = fresh(int(rng.integers(5, 700)))
        for _ in range(25):
            kept = base[rng.random(len(base)) >= 0.7 * rng.random() ** 4]
            sets.append(np.unique(np.concatenate([kept, fresh(int(rng.integers(0, 2 + len(base) // 30)))])))
            block.append(k)
    n, block, side = np.array([len(s) for s in sets]), np.array(block), rng.integers(0, 2, len(sets))
    order = np.lexsort((n, block))
    sets, n, block, side = [sets[k] for k in order], n[order], block[order], side[order]
    two = block % 2 == 1
    found = {(int(a), int(b)) for x, y in jaccard.alike(n, [jaccard.sketch(s) for s in sets], block, side, two, percent) for a, b in zip(x, y)}
    meet = {(a, b) for b in range(len(sets)) for a in range(b) if block[a] == block[b] and not (two[a] and side[a] == side[b])}
    linked = {(a, b) for a, b in meet if len(np.intersect1d(sets[a], sets[b])) >= jaccard.required(n[a] + n[b], percent)}
    assert linked and linked <= found <= meet
    assert len(found) < len(meet)


@pytest.mark.parametrize("group", [4, 1024])
def test_large_families_in_split_trees_stay_together(spark, prose, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    rng, texts = random.Random(3), []
    for family in range(2):
        base = prose(50, family).split()
        for k in range(25):
            copy = list(base)
            copy[rng.randrange(50)] = f"w{k}"
            texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in jaccard.join(docs_of(spark, texts), "doc_id", shingle=3, percent=60).collect()}
    assert got == {i: 0 if i < 25 else 25 for i in range(50)}


def test_secret_scan_follows_the_length_of_runs_and_texts(spark):
    """Each transition was cut from the whole token and each token from the whole text: minutes for these texts."""
    rng = random.Random(4)
    long = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=600_000))
    key = "Zk3Qx9TtB2mVw8LpRzQ7"
    texts = [f"a {long} b", f"{'read_only_configuration ' * 8000}{key}", "plain words and nothing else"]
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    began = time.monotonic()
    got = {r.doc_id: r.spans.split(",") for r in secrets.digest(docs_of(spark, texts).union(real), "doc_id").where("doc_id < 3").collect()}
    assert time.monotonic() - began < 60
    assert "random:2:600002" in got[0] and got[1] == ["random:192000:192020"] and got[2] == [""]


def test_runs_with_a_letter_are_the_tokens(spark):
    token = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{12,}"
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choices("aF0+-= .\u00e9", weights=(9, 3, 9, 3, 3, 3, 1, 1, 1), k=90))
        assert [m.span() for m in re.finditer(token, text)] == [m.span() for m in re.finditer(secrets.RUN, text) if re.search("[A-Za-z]", m[0])]


def test_secret_scan_searches_a_text_once_and_carries_no_model(spark, capsys):
    docs = docs_of(spark, ["token = abcdefghijklmnop and deadbeefdeadbeef00"])
    secrets.digest(docs, "doc_id").explain()
    assert "NestedLoopJoin" not in capsys.readouterr().out
