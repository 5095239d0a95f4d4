"""Matching of descriptors and fitting of pair transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import affine
from .nearest import two_nearest


def ratio_matches(pairs: DataFrame, features: DataFrame, metric: str = "l2", ratio: float = 0.75, round_to: int | None = None) -> DataFrame:
    """The matches whose nearest is nearer than ratio times the second; a feature without a second one has none."""
    return two_nearest(pairs, features, metric, round_to).filter(F.col("d1") < ratio * F.col("d2"))


def enough(matches: DataFrame, features: DataFrame, least_features: int = 8, least_matches: int = 6) -> DataFrame:
    """(source_id, target_id, num_matches) of pairs with enough features on both sides and enough matches."""
    rich = features.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_features)
    counts = matches.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("num_matches")).filter(F.col("num_matches") >= least_matches)
    for side in ("source_id", "target_id"):
        counts = counts.join(rich.select(F.col("frame").alias(side)), side, "left_semi")
    return counts.select("source_id", "target_id", "num_matches")


# What a model needs: points for a minimal sample.
SAMPLE = {"similarity": 2, "affine": 3, "homography": 4}


def fit(model: str, src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least squares for a 3x3 matrix; None where the points don't determine it. Points are centred and scaled first."""
    if len(src) < SAMPLE[model]:
        return None

    def conditioned(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid, spread = p.mean(0), max(float(np.sqrt(((p - p.mean(0)) ** 2).sum(1).mean())), 1e-9)
        return (p - mid) / spread, np.array([[1 / spread, 0, -mid[0] / spread], [0, 1 / spread, -mid[1] / spread], [0, 0, 1]])

    (a, ta), (b, tb) = conditioned(src), conditioned(dst)
    x, y, u, v, o, i = a[:, 0], a[:, 1], b[:, 0], b[:, 1], np.zeros(len(a)), np.ones(len(a))
    if model == "homography":
        rows = np.concatenate([np.stack([x, y, i, o, o, o, -u * x, -u * y, -u], 1), np.stack([o, o, o, x, y, i, -v * x, -v * y, -v], 1)])
        _, s, vt = np.linalg.svd(rows, full_matrices=True)
        if len(s) > 7 and s[7] < 1e-9:
            return None
        m = vt[-1].reshape(3, 3)
    elif model == "affine":
        sol, _, rank, _ = np.linalg.lstsq(np.stack([x, y, i], 1), b, rcond=None)
        if rank < 3:
            return None
        m = np.vstack([sol.T, [0, 0, 1]])
    else:
        sol, _, rank, _ = np.linalg.lstsq(np.concatenate([np.stack([x, -y, i, o], 1), np.stack([y, x, o, i], 1)]), np.concatenate([u, v]), rcond=None)
        if rank < 4:
            return None
        c, s, tx, ty = sol
        m = np.array([[c, -s, tx], [s, c, ty], [0, 0, 1]])
    m = np.linalg.inv(tb) @ m @ ta
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None


def errors(m: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    p = np.c_[src, np.ones(len(src))] @ m.T
    z = np.where(np.abs(p[:, 2]) < 1e-8, 1e-8, p[:, 2])
    return np.sqrt(((p[:, :2] / z[:, None] - dst) ** 2).sum(1))


def robust_fit(model: str, src: np.ndarray, dst: np.ndarray, threshold: float = 4.0, trials: int = 2000, confidence: float = 0.99, seed: int = 7):
    """(matrix, inlier mask) by random sampling: the sample with most inliers, refitted on them; (None, none) on failure."""
    n, k, rng = len(src), SAMPLE[model], np.random.default_rng(seed)
    best, count, trial, needed = np.zeros(n, bool), 0, 0, trials
    while trial < min(trials, needed) and n >= k:
        trial += 1
        some = rng.choice(n, k, replace=False)
        m = fit(model, src[some], dst[some])
        if m is None:
            continue
        inside = errors(m, src, dst) < threshold
        if inside.sum() > count:
            best, count = inside, int(inside.sum())
            share = count / n
            needed = int(np.ceil(np.log(1 - confidence) / np.log(max(1e-12, 1 - min(share**k, 1 - 1e-12))))) + 1
    if count < k:
        return None, best
    for _ in range(3):
        m = fit(model, src[best], dst[best])
        if m is None:
            return None, best
        again = errors(m, src, dst) < threshold
        if (again == best).all():
            break
        best = again
    return m, best


PAIR = "source_id {k}, target_id {k}, model_type string, matrix array<double>, num_matches int, num_inliers int, inlier_ratio double, reprojection_error double, status string"


def _estimate(model: str, threshold: float, least: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst, n = pdf[["sx", "sy"]].to_numpy(float), pdf[["tx", "ty"]].to_numpy(float), len(pdf)
        m, inside = robust_fit(model, src, dst, threshold) if n >= least else (None, np.zeros(n, bool))
        hits, status, rmse = int(inside.sum()), "success", 999.0
        if n < least or (m is not None and hits < least):
            status, m = "low_inliers", None
        elif m is None:
            status = "failed"
        else:
            rmse = float(np.sqrt((errors(m, src[inside], dst[inside]) ** 2).mean())) if hits else 999.0
            det = float(m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0])
            if not 0.05 < det < 20 or np.isnan(rmse):
                status, m, rmse = "failed_degenerate", None, 999.0
        flat = (np.eye(3) if m is None else m).ravel().tolist()
        return pd.DataFrame([(pdf["source_id"].iloc[0], pdf["target_id"].iloc[0], model, flat, n, hits, hits / n if n else 0.0, rmse, status)], columns=["source_id", "target_id", "model_type", "matrix", "num_matches", "num_inliers", "inlier_ratio", "reprojection_error", "status"])

    return of


def pair_transforms(points: DataFrame, model: str = "affine", threshold: float = 4.0, least_inliers: int = 15) -> DataFrame:
    """One robust transform per pair of (source_id, target_id, sx, sy, tx, ty). A pair's points are bounded by the feature limit."""
    if model not in SAMPLE:
        raise ValueError(f"unknown transform model: {model}")
    kind = points.schema["source_id"].dataType.simpleString()
    return points.groupBy("source_id", "target_id").applyInPandas(_estimate(model, threshold, least_inliers), PAIR.format(k=kind))


def valid_pairs(pairs: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The successful pairs whose source is a frame_id of sources and whose target is one of targets (else of sources too)."""
    ends = {"source_id": sources, "target_id": sources if targets is None else targets}
    out = pairs.filter("status = 'success'")
    for end, known in ends.items():
        out = out.join(known.select(F.col("frame_id").alias(end)).distinct(), end, "left_semi")
    return out


def frame_confidence(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """(frame_id, confidence): 1 for frames that some successful pair has at either end, else 0.5."""
    ends = pairs.filter("status = 'success'").select(F.explode(F.array("source_id", "target_id")).alias("frame_id")).distinct().withColumn("hit", F.lit(True))
    return frames.select("frame_id").join(ends, "frame_id", "left").select("frame_id", F.when(F.col("hit"), 1.0).otherwise(0.5).alias("confidence"))


def pair_records(transforms: DataFrame) -> DataFrame:
    """Transforms as the contract has them: the identity where there is no matrix, ratios with four and errors with three digits."""
    status = F.when(F.col("status") == "success", "accepted").when(F.col("status") == "low_inliers", "rejected").otherwise("fallback")
    m = F.coalesce("matrix", affine.matrix(*affine.IDENTITY))
    rows = F.array(*(F.slice(m, i, 3) for i in (1, 4, 7)))
    return transforms.select(
        "source_id", "target_id", F.col("model_type").alias("model"), rows.alias("matrix"), F.col("num_matches").alias("matches"), F.col("num_inliers").alias("inliers"),
        F.bround("inlier_ratio", 4).alias("inlier_ratio"), F.bround("reprojection_error", 3).alias("reprojection_error"), status.alias("status"),
    )


def strongest(features: DataFrame, limit: int, response: str, frame: str = "frame", kp: str = "kp") -> DataFrame:
    """The `limit` features of each frame with the greatest response, and their rank from 1; of equal ones the lesser kp is first."""
    order = Window.partitionBy(frame).orderBy(F.desc(response), kp)
    return features.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)


def compare_models(affine: DataFrame, homography: DataFrame, least_gain: float = 0.5) -> DataFrame:
    """(source_id, target_id, winner, gain): homography only if it is over least_gain px better with no fewer inliers."""
    side = lambda t, s: t.select("source_id", "target_id", *(F.col(c).alias(f"{s}_{c}") for c in ("status", "num_inliers", "reprojection_error")))
    both = side(affine, "a").join(side(homography, "h"), ["source_id", "target_id"])
    gain = F.col("a_reprojection_error") - F.col("h_reprojection_error")
    ok_a, ok_h = F.col("a_status") == "success", F.col("h_status") == "success"
    winner = F.when(ok_a & ok_h, F.when((gain > least_gain) & (F.col("h_num_inliers") >= F.col("a_num_inliers")), "homography").otherwise("affine")).when(ok_a, "affine").when(ok_h, "homography").otherwise("neither")
    return both.select("source_id", "target_id", winner.alias("winner"), gain.alias("gain"))


def match_statistics(transforms: DataFrame) -> DataFrame:
    """One row: pairs, inliers of the successful ones, and their mean inlier ratio and error (0 without any)."""
    ok = F.col("status") == "success"
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))
    return transforms.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(F.when(ok, F.col("num_inliers"))), F.lit(0)).alias("inliers"), mean("inlier_ratio").alias("mean_inlier_ratio"), mean("reprojection_error").alias("mean_error"))
