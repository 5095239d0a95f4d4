"""Poses and placement over DataFrames against one-machine versions of the same mathematics."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralign.functions import affine
from terralign.operators import placement, poses
from terralign.sources import checkpoints

from . import reference_solver

FRAMES = "survey string, frame_id string, easting double, northing double, yaw double, width int, height int"
PAIRS = "survey string, source_id string, target_id string, matrix array<double>, inlier_ratio double, status string"


def survey(name, side, rows, seed, links=True):
    rng = np.random.default_rng(seed)
    n = side * rows
    at = np.stack([np.arange(n) % side * 100.0, np.arange(n) // side * 80.0], 1)
    off = at + rng.normal(0, 2, at.shape)
    frames = [(name, f"{name}{k}", float(off[k, 0] * 0.1), float(-off[k, 1] * 0.1), float(rng.normal(0, 0.2)), 320, 240) for k in range(n)]
    pairs = []
    for k in range(n):
        for m in (k + 1, k + side):
            if links and m < n and (m != k + 1 or m % side):
                t, s = rng.normal(0, 0.002), 1 + rng.normal(0, 0.001)
                c, v = s * np.cos(t), s * np.sin(t)
                wrong = 25.0 if k == 5 else 0.0
                pairs.append((name, f"{name}{k}", f"{name}{m}", [float(x) for x in (c, -v, at[k, 0] - at[m, 0] + rng.normal(0, 0.2) + wrong, v, c, at[k, 1] - at[m, 1] + rng.normal(0, 0.2), 0, 0, 1)], float(rng.uniform(0.4, 1)), "success"))
    return frames, pairs


def test_poses_equal_the_dense_solver(spark):
    frames, pairs = [], []
    for f, p in (survey("a", 4, 3, 1), survey("b", 3, 2, 2), survey("c", 2, 1, 3, links=False)):
        frames += f
        pairs += p
    frames.append(("b", "b_lone", None, None, None, 320, 240))
    pairs += [("a", "a0", "unknown", pairs[0][3], 1.0, "success"), ("a", "a0", "a7", [9.0] * 9, 1.0, "failed")]
    got = poses.solve_poses(spark.createDataFrame(frames, FRAMES).repartition(3), spark.createDataFrame(pairs, PAIRS), 0.1, survey="survey").collect()
    assert len(got) == len(frames) and {r.confidence for r in got if r.survey == "c"} == {0.5}
    assert {r.frame_id for r in got if not r.connected} == {"b_lone", "c0", "c1"}
    for name in "abc":
        f = pd.DataFrame([x[1:] for x in frames if x[0] == name], columns=["frame_id", "easting", "northing", "yaw", "width", "height"])
        p = pd.DataFrame([x[1:5] for x in pairs if x[0] == name and x[5] == "success" and x[2] != "unknown"], columns=["source_id", "target_id", "matrix", "inlier_ratio"])
        want = dict(zip(f["frame_id"], reference_solver.solve(f, p, 0.1, rounds=400, least=1e-14)[0], strict=True))
        for r in got:
            if r.survey == name:
                assert np.allclose([r.world_x, r.world_y, r.rotation, r.scale], want[r.frame_id], atol=1e-6, rtol=0), (r, want[r.frame_id])


def test_one_survey_without_a_name(spark):
    frames, pairs = survey("x", 2, 2, 5)
    got = poses.solve_poses(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(pairs, PAIRS), 0.1)
    assert got.columns == ["frame_id", "world_x", "world_y", "scale", "rotation", "matrix", "confidence", "connected"] and got.count() == 4
    assert poses.solve_poses(spark.createDataFrame([], FRAMES), spark.createDataFrame([], PAIRS), 0.1).count() == 0


def test_linear_step_equals_numpy(spark, monkeypatch):
    """The conjugate gradients alone, for two systems, with clusters that cut most edges."""
    monkeypatch.setattr(poses, "CLUSTER", 3)
    rng = np.random.default_rng(6)
    frames, edges, want = [], [], {}
    for g, n in (("p", 7), ("q", 4)):
        a, b = np.zeros((n, 4, n, 4)), rng.normal(0, 1, (n, 4))
        for i in range(n):
            x = rng.normal(0, 1, (4, 4))
            a[i, :, i, :] = x @ x.T + 12 * np.eye(4)
        for i in range(n):
            j = (i + 1) % n
            block = rng.normal(0, 1, (4, 4))
            a[i, :, j, :] += block
            a[j, :, i, :] += block.T
            edges += [(g, i // 3, f"{i}", j // 3, f"{j}", block.ravel().tolist()), (g, j // 3, f"{j}", i // 3, f"{i}", block.T.ravel().tolist())]
        frames += [(g, f"{i}", i // 3, a[i, :, i, :][np.triu_indices(4)].tolist(), b[i].tolist()) for i in range(n)]
        want.update({(g, f"{i}"): v for i, v in enumerate(np.linalg.solve(a.reshape(4 * n, 4 * n), b.ravel()).reshape(n, 4))})
    found = poses.conjugate_gradients(spark.createDataFrame(frames, "g string, f string, c long, own array<double>, grad array<double>"), spark.createDataFrame(edges, "g string, c long, me string, oc long, other string, block array<double>"), checkpoints.Scratch(spark)).collect()
    assert len(found) == len(want) and all(np.allclose(r.x, want[r.g, r.f], atol=1e-7) for r in found)


def test_inverse_of_matrices(spark):
    m = np.random.default_rng(1).normal(0, 1, (20, 3, 3))
    rows = spark.createDataFrame([(x.ravel().tolist(),) for x in m], "m array<double>").select(affine.inverse(F.col("m")).alias("i"), affine.determinant(F.col("m")).alias("d"), "m").collect()
    assert all(np.allclose(np.reshape(r.i, (3, 3)), np.linalg.inv(np.reshape(r.m, (3, 3)))) and r.d == pytest.approx(np.linalg.det(np.reshape(r.m, (3, 3)))) for r in rows)


def walk(frames, pairs):
    """Level by level; a frame's parent is at the end of its first pair that leads one level back."""
    out = {}
    for g in {f[0] for f in frames}:
        own, near = [f for f in frames if f[0] == g], {}
        known = {f[1] for f in own}
        for number, (h, a, b, m) in enumerate(pairs):
            m = np.reshape(m, (3, 3))
            if h == g and a in known and b in known and abs(np.linalg.det(m)) > 1e-12:
                near.setdefault(a, []).append((number, b, np.linalg.inv(m)))
                near.setdefault(b, []).append((number, a, m))
        first = min(own, key=lambda f: f[1])
        placed, front = {first[1]: np.eye(3)}, [first[1]]
        while front:
            new = {}
            for here in front:
                for number, there, step in near.get(here, []):
                    if there not in placed and (there not in new or number < new[there][0]):
                        new[there] = (number, placed[here] @ step)
            placed.update({k: m for k, (_, m) in new.items()})
            front = list(new)
        for _, f, lat, lon in own:
            if f in placed:
                out[g, f] = ("visual", placed[f])
            elif lat is not None and lon is not None:
                lat0, lon0 = first[2] or 0.0, first[3] or 0.0
                dx = 6_371_000.0 * np.radians(lon - lon0) * np.cos(np.radians((lat + lat0) / 2)) * 10
                out[g, f] = ("gps", np.array([[1, 0, dx], [0, 1, -6_371_000.0 * np.radians(lat - lat0) * 10], [0, 0, 1.0]]))
    return out


def test_placement_equals_a_walk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frames = [(g, int(i), None if rng.random() < 0.2 else 51.5 + i * 1e-3, -0.1 + g * 1e-3) for g in range(3) for i in range(70)]
    pairs = []
    for g in range(3):
        for i in range(60):
            for j in ([i + 1] if g == 0 else rng.integers(0, 62, 2)):  # a long strip, and two tangles
                t, z = rng.normal(0, 0.3, 2)
                m = [float(x) for x in (np.cos(t), -np.sin(t), 30 + z, np.sin(t), np.cos(t), z, 1e-5 * z, 0, 1)]
                pairs.append((g, i, int(j), [0.0] * 9 if rng.random() < 0.03 and g else m) if rng.random() < 0.5 else (g, int(j), i, m))
    pairs += [(0, 3, 999, pairs[0][3])]
    pairs = [p for p in pairs if p[1] != p[2]]
    rows = spark.createDataFrame([(*p, k) for k, p in enumerate(pairs)], "s int, source_id long, target_id long, matrix array<double>, number long")
    rounds, cut = [], placement.cut
    monkeypatch.setattr(placement, "cut", lambda df: (rounds.append(df.columns), cut(df))[1])
    got = placement.place(spark.createDataFrame(frames, "s int, frame_id long, lat double, lon double"), rows, "s", ["frame_id"]).collect()
    want = walk(frames, pairs)
    assert {(r.s, r.frame_id): r.placed for r in got} == {k: v[0] for k, v in want.items()}
    assert all(np.allclose(np.reshape(r.matrix, (3, 3)), want[r.s, r.frame_id][1], atol=1e-6) for r in got)
    assert sum("moved" in c for c in rounds) <= 7  # a strip of sixty takes six doublings


def test_levels_read_the_edges_where_they_lie(spark, monkeypatch):
    """A round moves its own level only: the edges are cached by node, and no exchange takes them again."""
    plans, keep = [], placement.Scratch.keep
    monkeypatch.setattr(placement.Scratch, "keep", lambda self, df, *more: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(self, df, *more))[1])
    edges = spark.createDataFrame([(0, i, i + 1, 9 - i) for i in range(6)] * 2 + [(0, 0, 50, 1), (0, 50, 5, 1)], "g int, a long, b long, number long")
    known = spark.createDataFrame([(0, i) for i in range(7)], "g int, node long")
    got = placement.reached(edges, spark.createDataFrame([(0, 0)], "g int, node long"), known).collect()
    assert {(r.node, r.level, r.parent, r.number) for r in got} == {(0, 0, None, None)} | {(i, i, i - 1, 10 - i) for i in range(1, 7)}
    rounds = [p for p in plans if "min(struct(number" in p]
    assert len(rounds) >= 6 and all("InMemoryRelation" in p and "RepartitionByExpression" not in p.split("InMemoryRelation")[0] for p in rounds)


def test_levels_look_up_one_number(spark, monkeypatch):
    """Edges are looked up by a hash alone, which a scan does several times as fast as by columns; few rows are broadcast to
    them, many meet them where they lie. Ids may be of another type than the edges' ends. Either way the result is the same."""
    edges = spark.createDataFrame([(0, i, i + 1, 9 - i) for i in range(6)] * 2 + [(1, 0, 3, 1), (0, 3, 8, 2)], "g long, a long, b long, number long")
    start, found = spark.createDataFrame([(0, 0), (1, 3)], "g int, node int"), []
    for few in (1 << 19, 1):
        plans, keep = [], placement.Scratch.keep
        with monkeypatch.context() as patch:
            patch.setattr(placement, "FEW", few)
            patch.setattr(placement.Scratch, "keep", lambda self, df, *more: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(self, df, *more))[1])  # noqa: B023
            found.append({tuple(r) for r in placement.reached(edges, start).select("g", "node", "level", "parent", "number").collect()})
        joins = [line for p in plans if "min(struct(number" in p for line in p.splitlines() if "HashJoin" in line and "Inner" in line]
        assert len(joins) >= 6 and all(line.split("HashJoin")[1].split("]")[0].count("#") == 1 for line in joins)
    want = {(0, 0, 0, None, None), (0, 8, 4, 3, 2), (1, 3, 0, None, None), (1, 0, 1, 3, 1)} | {(0, i, i, i - 1, 10 - i) for i in range(1, 7)}
    assert found == [want, want]


def test_chosen_edges_leave_singular_ones(spark):
    """Two edges of one number between the same ends, of which one has no inverse."""
    pairs = spark.createDataFrame([(0, 2, 1, [0.0] * 9, 1), (0, 2, 1, [1.0, 0.0, 5.0, 0.0, 1.0, 7.0, 0.0, 0.0, 1.0], 1)], "s int, source_id long, target_id long, matrix array<double>, number long")
    frames = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 2, 1.0, 1.0)], "s int, frame_id int, lat double, lon double")
    got = placement.place(frames, pairs, "s", ["frame_id"]).collect()
    assert {(r.frame_id, r.placed, tuple(r.matrix)) for r in got} == {(1, "visual", affine.IDENTITY), (2, "visual", (1.0, 0, 5, 0, 1, 7, 0, 0, 1))}


def test_small_surveys_end_where_their_cluster_rests(spark, monkeypatch):
    """Surveys of one cluster take no round, and tables that nothing reads again don't pile up."""
    rounds, cg = [], poses.conjugate_gradients
    monkeypatch.setattr(poses, "conjugate_gradients", lambda *a: (rounds.append(a[0].select("g").distinct().count()), cg(*a))[1])
    frames, pairs = map(sum, zip(*(survey(f"s{k}", 3, 2, k) for k in range(3)), strict=True), ([], []))
    got = poses.solve_poses(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(pairs, PAIRS), 0.1, survey="survey").collect()
    assert len(got) == 18 and not rounds


def test_clusters_rest_side_by_side(monkeypatch):
    """One stream takes many clusters, whose equations are solved together and in parts; batches may end within a cluster, and
    neither other clusters nor parts of other sizes change a cluster's poses."""
    rows, nothing = [], dict.fromkeys(("f", "start", "s", "t", "m", "size", "weight"))
    for g, (side, high) in {"a": (4, 3), "b": (2, 1), "c": (4, 3), "d": (5, 2)}.items():
        frames, pairs = survey(g, side, high, side)
        rows += [nothing | {"g": g, "c": 0, "kind": 0, "f": f, "start": [x / 0.1, -y / 0.1, yaw, 1.0]} for _, f, x, y, yaw, *_ in frames]
        rows += [nothing | {"g": g, "c": 0, "kind": 1, "s": s, "t": t, "m": m, "size": [320.0, 240.0] * 2, "weight": w} for _, s, t, m, w, _ in pairs if (g, s) != ("d", "d4")]
    lists = pa.list_(pa.float64())
    kinds = pa.schema([("g", pa.string()), ("c", pa.int64()), ("kind", pa.int32()), ("f", pa.string()), ("start", lists), ("s", pa.string()), ("t", pa.string()), ("m", lists), ("size", lists), ("weight", pa.float64())])
    calls, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: (calls.append(a.shape), solve(a, b))[1])

    def settled(some, most):
        table = pa.Table.from_pylist(some, schema=kinds)
        out = pa.Table.from_batches(list(poses._settle(0.05)(iter(table.to_batches(max_chunksize=most)))))
        assert all(out.column("rested").to_pylist())
        return dict(zip(out.column("f").to_pylist(), out.column("p").to_pylist(), strict=True))

    whole = settled(rows, 1000)
    assert len(whole) == 36 and any(shape[0] > 1 for shape in calls)
    for other in (settled(rows, 3), *(settled([r for r in rows if r["g"] == g], 1000) for g in "abcd")):
        assert all(np.allclose(p, whole[f], atol=1e-5, rtol=0) for f, p in other.items())


def test_rounds_delete_what_nothing_reads_again(spark, monkeypatch):
    """Two clusters, steps cut short: what lies in the shared folder doesn't grow with the steps."""
    held, lies = set(), []
    keep, delete, linearise = poses.Scratch.keep, poses.Scratch._delete, poses.linearise
    monkeypatch.setattr(poses, "CLUSTER", 3)
    monkeypatch.setattr(poses, "STEPS", 3)
    monkeypatch.setattr(poses, "ROUNDS", 2)
    monkeypatch.setattr(poses.Scratch, "keep", lambda self, *a: (lambda df: (held.add(df.scratch), df)[1])(keep(self, *a)))
    monkeypatch.setattr(poses.Scratch, "_delete", lambda self, path: (held.discard(path), delete(self, path))[1])
    monkeypatch.setattr(poses, "linearise", lambda *a: (lies.append(len(held)), linearise(*a))[1])
    frames, pairs = survey("s", 3, 2, 1)
    got = poses.solve_poses(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(pairs, PAIRS), 0.1, survey="survey").collect()
    assert len(got) == 6 and all(r.connected for r in got)
    assert len(lies) >= 4 and lies[-1] <= lies[2] + 2
