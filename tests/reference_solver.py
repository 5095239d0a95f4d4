"""A survey's poses by one process, with NumPy: what the engine's solution over DataFrames is held against."""

from __future__ import annotations

import numpy as np
import pandas as pd


def conjugate_gradients(times, inverse: np.ndarray, right: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """x with times(x) = right, for (n, 4) blocks and the inverses of the diagonal blocks; pairs are never put in one matrix."""
    x, r = np.zeros_like(right), right.copy()
    z = np.einsum("ncd,nd->nc", inverse, r)
    way, size, least = z.copy(), float((r * z).sum()), tolerance**2 * float((right * right).sum())
    for _ in range(8 * right.size):
        if float((r * r).sum()) <= least or size <= 0:
            break
        ahead = times(way)
        length = size / float((way * ahead).sum())
        x, r = x + length * way, r - length * ahead
        z = np.einsum("ncd,nd->nc", inverse, r)
        size, before = float((r * z).sum()), size
        way = z + size / before * way
    return x


def solve(frames: pd.DataFrame, pairs: pd.DataFrame, gsd: float, prior: float = 0.05, rounds: int = 50, least: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, theta, scale) of each frame, and its start from the positions.

    Each pair asks four points of its source to land where its target puts them, weighted by its inlier ratio; large residuals
    count less by Cauchy's loss with a scale of 10 pixels. Each frame is drawn to its position, heading and scale 1. Gauss-Newton
    steps on the weighted equations, with damping that grows when a step doesn't help; each step is solved by conjugate gradients
    over blocks of 4 by 4 for frames and pairs, so memory follows frames plus pairs.
    """
    n = len(frames)
    e, nn = frames["easting"].fillna(frames["easting"].min()).to_numpy(float), frames["northing"].fillna(frames["northing"].max()).to_numpy(float)
    start = np.stack([(e - e.min()) / gsd, (nn.max() - nn) / gsd, np.radians(frames["yaw"].fillna(0.0).to_numpy(float)), np.ones(n)], 1)
    if not len(pairs):
        return start.copy(), start
    place = {f: i for i, f in enumerate(frames["frame_id"])}
    i, j = pairs["source_id"].map(place).to_numpy(), pairs["target_id"].map(place).to_numpy()
    w, h = frames["width"].to_numpy(float), frames["height"].to_numpy(float)
    weight = pairs["inlier_ratio"].to_numpy(float)
    share = np.array([[0.25, 0.25], [0.75, 0.25], [0.25, 0.75], [0.75, 0.75]])
    a = share[None] * np.stack([w[i], h[i]], 1)[:, None]
    m = np.stack(pairs["matrix"].to_list()).reshape(-1, 3, 3)
    b = np.einsum("pij,pkj->pki", m, np.concatenate([a, np.ones((*a.shape[:2], 1))], 2))
    b = b[..., :2] / b[..., 2:]
    a, b = a - np.stack([w[i], h[i]], 1)[:, None] / 2, b - np.stack([w[j], h[j]], 1)[:, None] / 2
    scales = prior * np.array([1.0, 1.0, 50.0, 100.0])

    def residuals(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def put(k: np.ndarray, q: np.ndarray) -> np.ndarray:
            c, s = np.cos(p[k, 2])[:, None] * p[k, 3, None], np.sin(p[k, 2])[:, None] * p[k, 3, None]
            return np.stack([p[k, 0, None] + c * q[..., 0] - s * q[..., 1], p[k, 1, None] + s * q[..., 0] + c * q[..., 1]], 2)

        off = p - start
        off[:, 2] = np.arctan2(np.sin(off[:, 2]), np.cos(off[:, 2]))
        return ((put(i, a) - put(j, b)) * weight[:, None, None]).ravel(), (off * scales).ravel()

    def cost(p: np.ndarray) -> float:
        return float(sum((100 * np.log1p((r / 10) ** 2)).sum() for r in residuals(p)))

    def blocks(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The derivatives of each pair's eight residuals by its source's and its target's four parameters."""
        found = []
        for k, q, sign in ((i, a, 1.0), (j, b, -1.0)):
            c, s = np.cos(p[k, 2])[:, None], np.sin(p[k, 2])[:, None]
            scale, one, none = p[k, 3, None], np.ones(q.shape[:2]), np.zeros(q.shape[:2])
            ux, uy = c * q[..., 0] - s * q[..., 1], s * q[..., 0] + c * q[..., 1]
            part = np.stack([np.stack([one, none, -scale * uy, ux], 2), np.stack([none, one, scale * ux, uy], 2)], 2)
            found.append((sign * weight[:, None, None, None] * part).reshape(len(k), 8, 4))
        return found[0], found[1]

    def add(rows: np.ndarray, values: np.ndarray, shape: tuple) -> np.ndarray:
        out = np.zeros(shape)
        np.add.at(out, rows, values)
        return out

    p, damping, now = start.copy(), 1e-3, cost(start)
    for _ in range(rounds):
        near, far = (r.reshape(-1, width) for r, width in zip(residuals(p), (8, 4), strict=True))
        w_near, w_far = 1 / (1 + (near / 10) ** 2), 1 / (1 + (far / 10) ** 2)
        left, right = blocks(p)
        gradient = add(i, np.einsum("pr,prd->pd", w_near * near, left), (n, 4)) + add(j, np.einsum("pr,prd->pd", w_near * near, right), (n, 4)) + scales * w_far * far
        own = add(i, np.einsum("pr,prc,prd->pcd", w_near, left, left), (n, 4, 4)) + add(j, np.einsum("pr,prc,prd->pcd", w_near, right, right), (n, 4, 4))
        own[:, range(4), range(4)] += scales**2 * w_far
        cross = np.einsum("pr,prc,prd->pcd", w_near, left, right)
        while damping < 1e8:
            diagonal = own.copy()
            diagonal[:, range(4), range(4)] += damping * (own[:, range(4), range(4)] + 1e-9)

            def times(v: np.ndarray, diagonal: np.ndarray = diagonal) -> np.ndarray:
                out = np.einsum("ncd,nd->nc", diagonal, v)
                np.add.at(out, i, np.einsum("pcd,pd->pc", cross, v[j]))
                np.add.at(out, j, np.einsum("pcd,pc->pd", cross, v[i]))
                return out

            step = conjugate_gradients(times, np.linalg.inv(diagonal), gradient)
            after = cost(p - step)
            if after <= now:
                break
            damping *= 10
        else:
            break
        gain, p, now, damping = now - after, p - step, after, max(damping / 10, 1e-9)
        if gain <= least * max(now, 1e-12):
            break
    return p, start
