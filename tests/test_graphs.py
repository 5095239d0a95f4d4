"""The greedy graph and its reach against a walk in order."""

import math

import numpy as np
import pytest

from terralign.operators import greedy, plan

R = 6_371_000.0


def haversine(a, b):
    (lat1, lon1), (lat2, lon2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def walk(track, reach, cap, flight_order=True, expand=True):
    """Frame by frame, neighbour by neighbour; track is [(id, lat, lon)] in order."""
    n, lat0, lon0 = len(track), np.mean([t[1] for t in track]), np.mean([t[2] for t in track])
    xy = [(R * math.radians(lon - lon0) * math.cos(math.radians((lat + lat0) / 2)), R * math.radians(lat - lat0)) for _, lat, lon in track]
    far = [[math.dist(p, q) for q in xy] for p in xy]
    if expand and any(all(d > reach for j, d in enumerate(row) if j != i) for i, row in enumerate(far)) and any(d <= 1.5 * reach for i, row in enumerate(far) for j, d in enumerate(row) if j != i):
        reach *= 1.5
    degree, taken = [0] * n, {}

    def take(i, j):
        a, b = sorted((track[i][0], track[j][0]))
        taken[a, b] = haversine(track[i][1:], track[j][1:])
        degree[i] += 1
        degree[j] += 1

    for i in range(n - 1):
        if flight_order and haversine(track[i][1:], track[i + 1][1:]) <= reach:
            take(i, i + 1)
    for i in range(n):
        for j in sorted((j for j in range(n) if j != i and far[i][j] < reach), key=lambda j: (far[i][j], j))[: 2 * cap]:
            if tuple(sorted((track[i][0], track[j][0]))) not in taken and degree[i] < cap and degree[j] < cap:
                take(i, j)
    return sorted(((a, b, d) for (a, b), d in taken.items()), key=lambda e: (round(e[2], 4), e[0], e[1])), degree


def flights(seed):
    """Wanderings, and one flight in lines."""
    rng = np.random.default_rng(seed)
    out = []
    for f, n in enumerate((1, 2, 30, 90, 150)):
        ids = rng.permutation(10_000)[:n] + f * 10_000
        k = np.arange(n)
        line = np.stack([k // 10 * 30.0, np.where(k // 10 % 2, 9 - k % 10, k % 10) * 30.0], 1) + rng.normal(0, 2, (n, 2))
        at = line if n > 100 else rng.normal(0, 12, (n, 2)).cumsum(0)
        out.append((f, [(int(i), 51.5 + float(a) * 1e-5, -0.1 + float(b) * 1e-5) for i, (a, b) in zip(ids, at, strict=True)]))
    return out


@pytest.mark.parametrize(("block", "cap", "flight_order"), [(4096, 6, True), (90, 4, False), (75, 6, True)])
def test_greedy_graph_equals_the_walk(spark, monkeypatch, block, cap, flight_order):
    monkeypatch.setattr(greedy, "BLOCK", block)
    own = flights(block)
    rows = [(f, i, k, lat, lon) for f, track in own for k, (i, lat, lon) in enumerate(track)] + [(1, -1, 99, None, 2.0)]
    frames = spark.createDataFrame(rows, "flight_id int, frame_id long, t int, lat double, lon double").repartition(3)
    got = plan.capped_graph(frames, ["t"], 60.0, cap, flight_order).collect()
    for f, track in own:
        want, degree = walk(track, 60.0, cap, flight_order)
        found = [(r.source_id, r.target_id, r.distance_m) for r in got if r.flight_id == f]
        assert [e[:2] for e in found] == [e[:2] for e in want]  # in order, too
        assert np.allclose([e[2] for e in found], [e[2] for e in want])
        assert max(degree, default=0) <= cap + 2 * flight_order


def test_reach_expands_for_all_if_it_helps_any(spark):
    """A lone frame, that nothing helps, and another that has one within the reach: the reach is expanded all the same."""
    frames = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 10.0, 0.0), (0, 3, 5000.0, 0.0), (1, 4, 0.0, 0.0), (1, 5, 80.0, 0.0), (2, 6, 0.0, 0.0), (2, 7, 120.0, 0.0), (3, 8, 0.0, 0.0), (3, 9, 500.0, 0.0)], "f int, frame_id long, x double, y double")
    assert {r.f: (r.isolated, r.helped, r.reach) for r in plan.expanded_reach(frames, 80.0, "x", "y", ["f"]).collect()} == {0: (1, 2, 120.0), 1: (0, 2, 80.0), 2: (2, 2, 120.0), 3: (2, 0, 80.0)}


def test_tight_clusters_keep_the_cap(spark):
    """All near one another: whatever the blocks, nobody has more than the cap."""
    frames = spark.createDataFrame([(0, i, i, 51.5 + i * 1e-6, -0.1) for i in range(60)], "flight_id int, frame_id long, t int, lat double, lon double")
    degree = np.zeros(60, int)
    for r in plan.capped_graph(frames, ["t"], 500.0, 3, flight_order=False).collect():
        degree[[r.source_id, r.target_id]] += 1
    assert degree.max() == 3 and (degree == 3).sum() >= 56


def test_groups_of_one_block_are_decided_in_one_step(spark, monkeypatch):
    """Many small groups, among them a null one: one table is written, and what edges carry comes along."""
    written, cut = [], greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda df: written.append(df) or cut(df))
    rng = np.random.default_rng(3)
    nodes, edges, want = [], [], set()
    for g in [None, *range(40)]:
        n = int(rng.integers(1, 9))
        start = rng.integers(0, 3, n).tolist()
        nodes += [(g, f"n{p}", p + 1, d) for p, d in enumerate(start)]
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
        for key, i in enumerate(rng.permutation(len(pairs)).tolist()):
            a, b = pairs[i]
            edges.append((g, f"n{a}", f"n{b}", key, a + 1, b + 1, float(i)))
            if start[a] < 3 and start[b] < 3:
                start[a], start[b] = start[a] + 1, start[b] + 1
                want.add((g, f"n{a}", f"n{b}", float(i)))
    of_nodes = spark.createDataFrame(nodes, "g int, u string, pu long, degree long")
    of_edges = spark.createDataFrame(edges, "g int, u string, v string, key long, pu long, pv long, metres double")
    got = greedy.capped(of_edges, of_nodes, 3).collect()
    assert {(r.g, r.u, r.v, r.metres) for r in got} == want and len(got) == len(want)
    assert len(written) == 1
    assert greedy.capped(of_edges.limit(0), of_nodes, 3).count() == 0
