import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralign.llm import near_dedup
from terralign.llm.components import components


def brute(rows, words, percent):
    """Components of documents by the sets of shingles themselves."""
    sets = {}
    for i, text in rows:
        got = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)})
        got = [w for w in got.split(" ") if w]
        n = min(words, len(got))
        sets[i] = {tuple(got[k : k + n]) for k in range(len(got) - n + 1)} if got else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                one, two = sorted((root(i), root(j)))
                label[two] = one
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            base = rnd.choice(texts).split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 8])):
                base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 30, 80, 200]))))
    return texts


def test_equals_brute_force(spark):
    texts = corpus() + [None, "", " \t\n", "Same Words Here", "same\twords\nhere", "a b c d e", "long " * 30_000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    for words, percent in ((4, 80), (5, 80)):
        got = {r.doc_id: r for r in near_dedup.resolve(docs, words=words, percent=percent).collect()}
        want = brute(rows, words, percent)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    left = near_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}


def test_rows_without_id_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    got = near_dedup.resolve(docs, words=4).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got if r.doc_id) == [(False, 3, False), (False, 3, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert near_dedup.resolve(docs.limit(0)).count() == 0
    assert near_dedup.deduplicate(docs.limit(0)).count() == 0


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    rnd = random.Random(3)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        words[rnd.randrange(60)] = f"edit{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.resolve(docs, words=4).collect()}
    assert got == want


def test_links_within_is_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint64)) for _ in range(120)]
    i, j = near_dedup.links_within(sets, 50)
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if 2 * len(np.intersect1d(sets[a], sets[b])) >= len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 99)]])
def test_components(spark, edges):
    import collections

    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want, seen = {}, set()
    for i in sorted(near):
        stack = [] if i in seen else [i]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                want[x] = i
                stack += near[x]
    frame = spark.createDataFrame(edges, "a long, b long").withColumn("noise", F.lit(1))
    assert {r.node: r.component for r in components(frame).collect()} == want


def test_deduplicate_with_clashing_columns_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a", 9), (1, text, "a", 9), (2, text + " more", "b", 9), (3, "other words here", "c", 9), (None, "x", "d", 9), (None, "x", "d", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone string, gone long")
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r["__gone"]) for r in kept.collect()) == [(0, "d"), (0, "d"), (1, "a"), (3, "c")]


def test_less_than_the_least_similarity_is_refused(spark):
    with pytest.raises(ValueError):
        near_dedup.resolve(spark.createDataFrame([], "doc_id long, text string"), percent=60)
