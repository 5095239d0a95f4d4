"""Operators over ranges of an order, against plain Python, with a group over many partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralign.operators import ordered, plan, telemetry


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    out = [("huge", int(i), float(v)) for i, v in enumerate(rng.integers(0, 400, 3000))] + [(None, i, float(i % 3)) for i in range(7)] + [("one", 5, 1.0)]
    out += [(f"g{i % 40}", i, float(rng.integers(0, 9))) for i in range(400)]
    return [out[i] for i in rng.permutation(len(out))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, t long, v double").repartition(5)


def groups(rows):
    by = {}
    for g, t, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(g, []).append((t, v))
    return by


def test_a_huge_group_covers_partitions(frame):
    parts = ordered.dealt(frame, ["g"], ["t"]).filter("g = 'huge'").groupBy(ordered.PART).count().collect()
    assert len(parts) >= 3


def test_neighbours(frame, rows):
    got = ordered.beside(frame, ["g"], ["t"], ["v"], lambda w: {"ahead": F.lead("v").over(w), "behind": F.lag("v").over(w)})
    assert got.columns == ["g", "t", "v", "ahead", "behind"]
    want = {}
    for g, own in groups(rows).items():
        for k, (t, v) in enumerate(own):
            want[g, t] = (v, own[k + 1][1] if k + 1 < len(own) else None, own[k - 1][1] if k else None)
    found = got.collect()
    assert len(found) == len(rows) and {(r.g, r.t): (r.v, r.ahead, r.behind) for r in found} == want


def test_places_and_running_sums(frame, rows):
    both = ordered.running(ordered.ranked(frame, ["g"], ["t"]), ["g"], ["t"], F.col("v"), "upto").collect()
    want = {}
    for g, own in groups(rows).items():
        for k, (t, _) in enumerate(own):
            want[g, t] = (k + 1, sum(v for _, v in own[: k + 1]))
    assert len(both) == len(rows) and {(r.g, r.t): (r.pos, r.upto) for r in both} == want


@pytest.mark.parametrize("by", [["g"], []])
def test_medians(frame, rows, by):
    nulls = frame.unionByName(frame.limit(5).withColumn("v", F.lit(None).cast("double")))
    upper = {(r.g if by else 0): r.m for r in ordered.upper_median(nulls, by, "v", "m").collect()}
    true = {(r.g if by else 0): r.m for r in ordered.median(nulls, by, "v", "m").collect()}
    own = {g: [v for _, v in x] for g, x in groups(rows).items()} if by else {0: [v for *_, v in rows]}
    assert upper == {g: sorted(x)[len(x) // 2] for g, x in own.items()}
    assert true == {g: float(np.median(x)) for g, x in own.items()}


def test_no_rows(spark, frame):
    none = frame.limit(0)
    assert ordered.ranked(none, ["g"], ["t"]).count() == 0 and ordered.upper_median(none, ["g"], "v", "m").count() == 0
    assert ordered.beside(none, ["g"], ["t"], [], lambda w: {"x": F.lead("t").over(w)}).count() == 0
    assert plan.target_resolution(spark.createDataFrame([(0.0,)], "gsd double"), 2.0).first()[0] is None


def test_one_long_flight(spark):
    """The headings, stages and sessions of one group of 2,000 rows are those of a plain walk."""
    rng = np.random.default_rng(2)
    track = [(0, i, float(x), float(y), None if rng.random() < 0.7 else 45.0) for i, (x, y) in enumerate(rng.normal(0, 3, (2000, 2)).cumsum(0))]
    got = {r.i: r.yaw for r in plan.fill_headings(spark.createDataFrame(track, "f int, i int, easting double, northing double, yaw double"), ["f"], ["i"]).collect()}
    for i, (_, _, x, y, yaw) in enumerate(track):
        a, b = ((x, y), track[i + 1][2:4]) if i + 1 < len(track) else (track[i - 1][2:4], (x, y))
        de, dn = b[0] - a[0], b[1] - a[1]
        way = (np.degrees(np.arctan2(de, dn)) + 360) % 360 if np.hypot(de, dn) > 2 else 0.0
        assert got[i] == pytest.approx(way if yaw is None else yaw)
    at = np.cumsum(rng.integers(0, 20, 2000))
    log = spark.createDataFrame([("r", int(t), i, f"s{i % 5}") for i, t in enumerate(at)], "run string, second long, seq int, stage string").withColumn("ts", F.timestamp_seconds("second"))
    seconds = {r.stage: r.seconds for r in telemetry.stage_durations(log, ["run"]).collect()}
    assert seconds == {f"s{i % 5}": float(at[i + 1] - at[i]) for i in range(1999)}
    sessions = sorted((r.session, r.files) for r in telemetry.settled_sessions(log, ["run"], 15).collect())
    starts = [0] + [i for i in range(1, 2000) if at[i] - at[i - 1] >= 15] + [2000]
    assert sessions == [(k + 1, b - a) for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]
