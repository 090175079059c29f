"""The language model against brute force, its sequences, and awkward tables."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ngrams, queries
from tickloom.llm.eliasfano import Monotone, Trie

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size, most", [(1, 1), (1, 10**12), (5, 3), (1000, 50), (1000, 10**9), (5000, 10**15), (70_000, 10**6)])
def test_monotone_sequence_round_trip(size, most):
    rng = np.random.default_rng(size + most)
    v = np.sort(rng.integers(0, most, size))
    m = Monotone.of(v)
    assert (m.access(np.arange(size)) == v).all()
    x = np.concatenate([v, rng.integers(0, most + 5, 3000)])
    a = rng.integers(0, size + 1, len(x))
    b = np.minimum(size, a + rng.integers(0, size + 1, len(x)))
    assert (m.successor(x, a, b) == np.clip(np.searchsorted(v, x), a, b)).all()
    if size >= 5000:  # low bits, two high bits, and the counts
        assert sum(p.nbytes for p in m.parts().values()) * 8 <= size * (math.log2(most / size) + 3) + 2048


def test_mapped_trie_finds_its_grams_and_no_others():
    rng = np.random.default_rng(4)
    grams = np.unique(rng.integers(0, 60, (4000, 3)), axis=0)
    a, b, c = grams.T
    heads, pairs = ngrams._starts(a), ngrams._starts(a, b)
    codes = np.arange(len(c)).astype(np.uint16)
    levels = [(a[heads], None, {}), (b[pairs], np.searchsorted(pairs, ngrams._ends(heads, len(a))), {}), (c, ngrams._ends(pairs, len(a)), {"code": codes})]
    trie = Trie.of(levels).mapped()
    assert isinstance(trie.levels[2][2]["code"].base, np.ndarray)
    ask = rng.integers(0, 62, (20_000, 3))
    node = np.zeros(len(ask), np.int64)
    for k in range(3):
        node = trie.find(k, node, ask[:, k])
    place = {tuple(g): i for i, g in enumerate(grams.tolist())}
    assert node.tolist() == [place.get(tuple(g), -1) for g in ask.tolist()]
    assert (trie.column(2, "code", node, 7) == np.where(node >= 0, codes[node], 7)).all()


def test_messages_round_trip():
    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([70_000, 1]), np.array([2**63 + 5, 1], np.uint64)]
    back = ngrams.unpack(ngrams.pack(*arrays))
    assert [x.tolist() for x in back] == [x.tolist() for x in arrays]


def scores(texts, train, discount=ngrams.DISCOUNT):
    """(n_tokens, n_known, base, score) of each text by dictionaries."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    seqs = [[*(t or "").encode().translate(lower).split(), "end"] for t in texts]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for s, t in zip(seqs, train):
        if t:
            one.update(s)
            s = ["first", "begin", *s]
            two.update(zip(s[1:], s[2:]))
            three.update(zip(s, s[1:], s[2:]))
    n2, t2, n3, t3 = (collections.Counter() for _ in range(4))
    for (u, _), n in two.items():
        n2[u] += n
        t2[u] += 1
    for (u, v, _), n in three.items():
        n3[u, v] += n
        t3[u, v] += 1
    total, known, out = sum(one.values()), len(one), []
    for s in seqs:
        base = full = 0.0
        for u, v, w in zip(["first", "begin", *s], ["begin", *s], s):
            p1 = p = (one[w] + 1) / (total + known + 1)
            if n2[v]:
                p = max(two[v, w] - discount, 0) / n2[v] + discount * t2[v] / n2[v] * p
            if n3[u, v]:
                p = max(three[u, v, w] - discount, 0) / n3[u, v] + discount * t3[u, v] / n3[u, v] * p
            base += math.log10(p1)
            full += math.log10(p)
        out.append((len(s), sum(w in one for w in s), base, full))
    return out, total


@pytest.mark.parametrize("room", [ngrams.ROOM, 4000, 150])
def test_scores_match_brute_force(spark, room):
    """Also with so little room that words and pairs are split."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("text", F.regexp_replace("text", r"\b(\w)\w+", "$1$1") if room < 1000 else F.col("text"))
    docs = docs.unionByName(docs.where("doc_id % 9 = 0"))
    rows = docs.collect()
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    got = ngrams.score(docs.repartition(5), "doc_id", "lang", train=train, room=room).collect()
    flags = [zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in rows]
    want, total = scores([r.text for r in rows], flags)
    found = sorted((r.doc_id, r.lang, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in got)
    expected = sorted((r.doc_id, r.lang, not f, n, k, b, s, total) for r, f, (n, k, b, s) in zip(rows, flags, want))
    for g, e in zip(found, expected, strict=True):
        assert g[:5] == e[:5] and g[7] == e[7]
        assert g[5] == pytest.approx(e[5], rel=1e-9) and abs(g[6] - e[6]) <= g[3] / ngrams.STEPS  # the codes of a token are within half a step, two of them multiplied


def test_model_beats_its_words_on_held_out_texts(spark):
    rows = [r for r in queries.op11_ngrams(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows) or sum(r.score > r.base_score for r in rows) > 0.7 * len(rows)


def test_unknown_words_after_known_contexts(spark):
    texts = ["a b c a b", "a b a c", "b b"]
    vocabulary = ["a", "b", "c", "zzz"]
    docs = [(i, t, True) for i, t in enumerate(texts)] + [(10, "a b", False)] + [(11 + i, f"a b {w}", False) for i, w in enumerate(vocabulary)]
    rows = {r.id: r for r in ngrams.score(spark.createDataFrame(docs, "id long, text string, t boolean"), "id", train=F.col("t")).collect()}
    want, _ = scores([d[1] for d in docs], [d[2] for d in docs])
    assert all(rows[d[0]].score == pytest.approx(w[3], abs=w[0] / ngrams.STEPS) for d, w in zip(docs, want))


def test_scores_take_awkward_tables(spark, awkward, nothing):
    for train in (F.col("doc_id") != 6, F.lit(False), F.lit(True)):
        rows = ngrams.score(awkward, "doc_id", "text", "size", train=train).collect()
        assert len(rows) == awkward.count() and {r.size for r in rows} == {"other"}
        by = {r.doc_id: r for r in rows}
        assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[6].n_tokens == 30_001
        assert all(r.score <= 0 and r.base_score <= 0 for r in rows)
        same = [r for r in rows if r.doc_id == 1]
        assert same[0] == same[1]
    assert all(r.n_known == 0 and r.held_out for r in ngrams.score(awkward, "doc_id", train=F.lit(None).cast("boolean")).collect())
    assert ngrams.score(nothing, "doc_id", train=F.lit(True)).collect() == []
