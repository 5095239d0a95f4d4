"""Language identification by the nearest of several centroids per language, with rejection by distance.

A text's vector holds the character 1-, 2- and 3-grams of its lower-cased letters, runs of other characters counting as one
space, hashed to DIMS places, as (1 + log count) * idf, scaled
to length 1. Document frequencies cover all training rows. The centroids of a language come from spherical k-means over a
sample of about SAMPLE of its training rows (a hash of id and text decides, at a rate of SAMPLE / rows of the language): the
bound of the fit. Rows that are alike in id and text are sampled as one, and rows without id, or that share one, by their texts,
so the bound holds for any ids. A prediction is the language of the centroid with the greatest cosine; it is marked rejected where the
cosine is below the 0.005 quantile of the centroid's own training members, less MARGIN.

Null texts and texts without a letter are `und` with score 0, rejected. Training rows with null text, or null language, teach
nothing; without any training row every prediction is `und`. Ties go to the language that comes first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DIMS, SAMPLE, CENTROIDS, ROUNDS, MARGIN = 4096, 1000, 4, 12, 0.05


_MEMO: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    if "letters" not in _MEMO:
        _MEMO["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _MEMO["letters"]


def counts(text: str) -> np.ndarray:
    """How often each place of the vector is hit."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    c = np.where(letter, c, 32)[letter | np.r_[True, letter[:-1]]].astype(np.uint64)
    one, two = c * np.uint64(0x9E3779B97F4A7C15), c * np.uint64(0xC2B2AE3D27D4EB4F)
    pair = one[:-1] + (two[1:] ^ np.uint64(0x5851F42D4C957F2D))
    three = pair[:-1] * np.uint64(0x165667B19E3779F9) + one[2:] if len(c) > 2 else pair[:0]
    every = np.concatenate([one, pair * np.uint64(0xD6E8FEB86659FD93), three * np.uint64(0xFF51AFD7ED558CCD)])
    return np.bincount((every >> np.uint64(52)).astype(np.int64), minlength=DIMS)


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    n = counts(text)
    v = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * idf
    return (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for t in b.column(0).to_pylist():
            total += counts(t) > 0
            rows += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.r_[rows, total])], ["place", "n"])


def _clusters(idf: np.ndarray):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([vector(t, idf) for t in pdf.sort_values(["order", "text"])["text"]])
        mean = x.mean(0)
        at = [int((x @ mean).argmax())]
        while len(at) < min(CENTROIDS, len(x)):  # the row farthest from all chosen ones
            at.append(int((x @ x[at].T).max(1).argmin()))
        c = x[at].copy()
        for _ in range(ROUNDS):
            near = (x @ c.T).argmax(1)
            for k in range(len(c)):
                if (near == k).any():
                    m = x[near == k].mean(0)
                    c[k] = m / max(np.sqrt(m @ m), 1e-12)
        cos = x @ c.T
        near = cos.argmax(1)
        floor = [float(np.quantile(cos[near == k, k], 0.005)) - MARGIN if (near == k).any() else 1.0 for k in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [v.tobytes() for v in c], "floor": floor})

    return fit


def sampled(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The distinct rows (order, lang, text) that the centroids are fitted to; copies of a row meet in the map-side combine."""
    place = F.pmod(F.xxhash64("order", "text"), F.lit(1_000_000))
    return texts.join(sizes, "lang").filter(place * F.col("__n") < SAMPLE * 1_000_000).select("order", "lang", "text").distinct()


def train(texts: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray] | None:
    """From (order, lang, text): idf, and the languages, vectors and least cosines of the centroids."""
    texts = texts.filter("lang IS NOT NULL AND text IS NOT NULL")
    found = {r.place: r.n for r in texts.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    rows = found.pop(-1, 0)
    if not rows:
        return None
    idf = np.log((1 + rows) / (1 + np.array([found[k] for k in range(DIMS)]))) + 1
    sizes = F.broadcast(texts.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")))  # a row per language
    sample = sampled(texts, sizes)
    fitted = sample.groupBy("lang").applyInPandas(_clusters(idf), "lang string, centroid binary, floor double").collect()
    fitted.sort(key=lambda r: r.lang)
    if not fitted:
        return None
    return idf, [r.lang for r in fitted], np.stack([np.frombuffer(r.centroid, np.float32) for r in fitted]), np.array([r.floor for r in fitted])


def _predict(shipped, letters_at: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centroids, floor = shipped.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts, letters = b.column(letters_at + 1).to_pylist(), b.column(letters_at).to_pylist()
                some = [i for i, ok in enumerate(letters) if ok]
                lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if some:
                    cos = np.stack([vector(texts[i], idf) for i in some]) @ centroids.T
                    best = cos.argmax(1)
                    for i, k, c in zip(some, best.tolist(), cos[np.arange(len(some)), best].tolist(), strict=True):
                        lang[i], score[i], rejected[i] = langs[k], min(1.0, max(0.0, c)), c < floor[k]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(letters_at)), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)], [*b.schema.names[:letters_at], "lang_pred", "score", "rejected"])

    return emit


def identify(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row; rows where `learn` holds teach."""
    chosen = docs.select(F.col(id_col).alias("order"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), learn.alias("learn"))
    model = train(chosen.filter("learn").select("order", "lang", "text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), 1), f"doc_id {kind}, lang_pred string, score double, rejected boolean")
