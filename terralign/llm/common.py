"""What the text operators share: checkpoints, joins that survive hot keys, word hashes."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least one part in HOT of all rows, so at most HOT keys are.
HOT = 512


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the cluster's shared folder (spark.checkpoint.dir); a temporary one only on a single machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that a lost executor costs no more than its own tasks."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def join_unique(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Left join with a right side that has each key once and knows in `weight` how many left rows have it.

    Keys with 1/HOT of all rows or more, of which there can be HOT at most, are broadcast;
    the rest is joined by a shuffle in which no key has more than total / HOT rows.
    Both sides are read twice: pass checkpointed or cheap frames.
    """
    limit = max(total // HOT, 1000)
    hot = F.broadcast(right.filter(F.col(weight) >= limit))
    far = left.join(F.broadcast(right.filter(F.col(weight) >= limit).select(*on)), on, "left_anti")
    return left.join(hot, on, "inner").unionByName(far.join(right.filter(F.col(weight) < limit), on, "left"))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers (long) that hash partitioning deals to n different partitions of n."""
    found: list = []
    size = 16 * n
    while len(found) < n:
        numbers = spark.range(size)
        found = numbers.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
        size *= 4
    return sorted(r.id for r in found)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of UTF-8 texts, words being runs without ASCII white space; A-Z count as a-z.

    A word's hash is the polynomial of its bytes modulo 2**64, mixed; the running sums are taken over a whole text at once.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self) -> None:
        self.fold = np.arange(256, dtype=np.uint64)
        self.fold[65:91] += np.uint64(32)
        self.fold = mix64(self.fold + np.uint64(0x51ED27))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << int(n - 1).bit_length()
            back = np.uint64(pow(int(self.BASE), -1, 1 << 64))
            for name, base in (("power", self.BASE), ("inverse", back)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def __call__(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(text, np.uint8)
        gap = self.space[raw]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        start, end = edge[::2], edge[1::2]
        self._grow(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.fold[raw] * self.power[: len(raw)], out=total[1:])
        return mix64((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words; of the whole sequence where it has fewer; of nothing where it is empty."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out, width, size = words * np.uint64(0xD6E8FEB86659FD93), 1, len(words) - n + 1
    total, place = None, 0
    while True:  # runs of 1, 2, 4, ... words make up a run of n
        if n & width:
            part = out[place : place + size]
            total, place = (part if total is None else total * _power(width) + part), place + width
        if 2 * width > n:
            return mix64(total + np.uint64(n))
        out, width = out[:-width] * _power(width) + out[width:], 2 * width


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64))
