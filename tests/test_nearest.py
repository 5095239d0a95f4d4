"""The two nearest descriptors, over blocks, against all pairs."""

import numpy as np
import pytest

from terralign.operators import matching, nearest


def brute(pairs, rows, metric, digits):
    by, out = {}, {}
    for f, kp, d in rows:
        if d is not None:
            by.setdefault(f, []).append((kp, np.array(d)))
    for a, b in pairs:
        for q, x in by.get(a, []):
            far = [(round(float(np.sqrt(((x - y) ** 2).sum())), digits) if metric == "l2" else int(sum(int(v).bit_count() for v in (x ^ y).astype(np.uint64))), t) for t, y in by.get(b, [])]
            far.sort()
            if far:
                out[a, b, q] = (far[0][1], far[0][0], far[1][0] if len(far) > 1 else None)
    return out


def table(metric, seed):
    """Frames of descriptors in clusters, with repeats; frame 4 has one feature and frame 5 none with a descriptor."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 30, (9, 6)) if metric == "l2" else rng.integers(0, 2**63, (9, 2))
    rows = []
    for f, n in ((0, 260), (1, 190), (2, 40), (3, 25), (4, 1)):
        for k in range(n):
            c = middle[int(rng.integers(0, 9))]
            if metric == "l2":
                d = (np.round(c + rng.normal(0, 1, 6), 1) if rng.random() < 0.8 else c).tolist()
            else:
                flip = sum(1 << int(b) for b in rng.integers(0, 62, int(rng.integers(0, 4))))
                d = [int(c[0]) ^ flip, int(c[1])]
            rows.append((f, f * 1000 + k, d))
    return [*rows, (5, 5000, None)]


@pytest.mark.parametrize("metric", ["l2", "hamming"])
@pytest.mark.parametrize(("block", "pivots"), [(1024, 256), (10, 40)])
def test_equals_all_pairs(spark, monkeypatch, metric, block, pivots):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "PIVOTS", pivots)
    rows = table(metric, block)
    pairs = [(0, 1), (1, 0), (2, 3), (0, 4), (4, 0), (2, 5), (5, 2), (0, 1), (3, 99)]
    features = spark.createDataFrame(rows, f"frame int, kp long, desc array<{'double' if metric == 'l2' else 'long'}>").repartition(3)
    asked = spark.createDataFrame(pairs, "source_id int, target_id int")
    got = matching.two_nearest(asked, features, metric, 6 if metric == "l2" else None).collect()
    assert {(r.source_id, r.target_id, r["query"]): (r.best, r.d1, r.d2) for r in got} == brute(sorted(set(pairs)), rows, metric, 6)
    assert len(got) == len({(r.source_id, r.target_id, r["query"]) for r in got})
    if block == 10:
        parts, gaps = nearest.blocks(features, metric)
        of = {r.frame: r["count"] for r in parts.groupBy("frame").count().collect()}
        met = nearest.candidates(asked.filter("source_id < 2 AND target_id < 2").distinct(), parts, gaps).count()
        assert 0 < met < 0.6 * 2 * of[0] * of[1]  # clusters apart: the bounds drop most pairs of blocks


def test_descriptors_alike(spark):
    """Every feature is as near as any other: the lesser key wins, and no more than two rows a block leave a task."""
    rows = [(f, f * 100 + k, [1.0, 2.0]) for f in (0, 1) for k in range(50)]
    got = matching.two_nearest(spark.createDataFrame([(0, 1)], "source_id int, target_id int"), spark.createDataFrame(rows, "frame int, kp long, desc array<double>")).collect()
    assert len(got) == 50 and {(r.best, r.d1, r.d2) for r in got} == {(100, 0.0, 0.0)}
    row, _, _ = nearest.two_best(np.ones((5, 2)), np.ones((40, 2)), np.arange(40), "l2", 6)
    assert len(row) == 10


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        matching.two_nearest(spark.range(1), spark.range(1), "cosine")


def test_no_features(spark):
    none = spark.createDataFrame([], "frame int, kp long, desc array<double>")
    assert matching.two_nearest(spark.createDataFrame([(0, 1)], "source_id int, target_id int"), none).count() == 0
