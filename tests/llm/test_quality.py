import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terralign.llm import quality

PAD = -1


def runs(text):
    s = [PAD] * (quality.ORDER - 1) + [ord(c) for c in text]
    return zip(*(s[i:] for i in range(quality.ORDER)), strict=False)


def brute(texts):
    """Log-probabilities of an interpolated modified Kneser-Ney model, with dictionaries."""
    counts = Counter(g for t in texts for g in runs(t))
    low, levels = counts, {}
    while len(next(iter(low))) > 1:
        levels[len(next(iter(low)))] = low
        low = Counter(g[1:] for g in low)
    levels[1] = low

    def order(counts):
        n = [max(1, sum(1 for c in counts.values() if c == k)) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3)]
        whole, freed = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            whole[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        return lambda g, low: (((counts[g] - d[min(counts[g], 3) - 1]) if g in counts else 0) + freed[g[:-1]] * low) / whole[g[:-1]] if g[:-1] in whole else low

    orders = [order(levels[k]) for k in range(1, quality.ORDER + 1)]

    def logp(g):
        p = 1 / (len(levels[1]) + 1)
        for k, f in enumerate(orders, 1):
            p = f(g[-k:], p)
        return math.log(p)

    return logp


def corpus(seed=1):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randrange(3, 80))) for _ in range(150)]


def held_back(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "i long")
    return {r.i for r in rows.filter(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(quality.HELD)) == 0).collect()}


@pytest.mark.parametrize("shard, piece", [(1_000_000, 1_000_000), (300, 50)])
def test_perplexity_equals_brute_force_and_junk_goes(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(quality, "SHARD", shard)
    monkeypatch.setattr(quality, "PIECE", piece)
    texts = corpus()
    junk = ["ZQ%%% XK$$$ " * 20, "0101 1100 | " * 30]
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)] + [(500 + i, t, "en") for i, t in enumerate(junk)]
    rows += [(600, None, "en"), (601, "", "en"), (602, texts[0], "xx"), (0, texts[0], None), (None, texts[2], "en")]
    docs = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], "doc_id long, text string, lang string, n string, __bad string, id string, key string, good string, row_key string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(500, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    trusted = [i for i in range(120) if i != 3]
    counted = set(trusted) - held_back(spark, trusted)
    logp = brute([texts[i] for i in counted] + ([texts[0]] if 0 in counted else []))
    got = quality.score(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        text = dict((a, b) for a, b, _ in rows)[r.doc_id]
        if text:
            assert r.perplexity == pytest.approx(math.exp(-sum(map(logp, runs(text))) / len(text)), rel=1e-6)
        else:
            assert r.perplexity is None and not r.accepted
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert not left & {500, 501, 600, 601} and left >= set(range(150)) | {602}


def test_any_number_of_characters(spark):
    rnd = random.Random(7)
    letters = [chr(0x4E00 + int(700 * rnd.random() ** 2)) for _ in range(4000)] + [chr(0x1F600 + i) for i in range(40)]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 120))) for _ in range(120)]
    assert len(set("".join(texts))) > 500
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)] + [(900, "\u0416\u0000" + texts[0], "zh")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    logp = brute([texts[i] for i in range(100) if i not in held_back(spark, range(100))])
    for r in quality.score(docs, labels).collect():
        text = texts[r.doc_id] if r.doc_id < 900 else "\u0416\u0000" + texts[0]
        assert r.perplexity == pytest.approx(math.exp(-sum(map(logp, runs(text))) / len(text)), rel=1e-6)


def test_no_trusted_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.accepted for r in quality.score(docs, labels).collect()} == {1: True, 2: False}
    assert quality.score(docs.limit(0), labels).count() == 0


def test_whole_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    trusted = {r.doc_id for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").collect()} & set(rows)
    apart = held_back(spark, trusted)
    logp = brute([rows[i].text for i in trusted - apart if rows[i].text])
    nll = {i: -sum(map(logp, runs(r.text))) / len(r.text) for i, r in rows.items() if r.text}
    wide = {i: max(1.0, math.sqrt(quality.SHORT / len(rows[i].text))) for i in nll}

    def quantile(values, p):
        return sorted(values)[max(1, math.ceil(p * len(values) - 1e-9)) - 1]

    def bounds(ids, lang):
        ids = [i for i in ids if i in nll]
        own = [i for i in ids if rows[i].lang == lang] or ids
        mid = quantile([nll[i] for i in own], 0.5)
        far = [(nll[i] - mid) / wide[i] for i in own]
        return mid, quantile(far, 0.01), quantile(far, 0.99)

    good = set()
    for i in nll:
        sides = [bounds(ids, rows[i].lang) for ids in (apart, trusted)]
        low = min(mid + quality.SLACK * a * wide[i] for mid, a, _ in sides)
        high = max(mid + quality.SLACK * b * wide[i] for mid, _, b in sides)
        if low <= nll[i] <= high:
            good.add(i)
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == good
