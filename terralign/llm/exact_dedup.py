"""Exact dedup by a Golomb-coded exchange of fingerprints.

1. One scan gives each row a 64-bit fingerprint and the SHA-256 of its text; the texts stay where they are.
2. Each partition sorts its fingerprints, cut to log2(rows) + 10 bits, codes their gaps with a Golomb-Rice code and sends
   each owner (a range of fingerprints) its block.
3. Owners merge their blocks and send back one bit per fingerprint: seen more than once, or not.
4. Blocks and bits meet, one row each for partition and owner, and give the suspect fingerprints, cut as they were sent. A
   second scan sends the suspects' texts only, and grouping them by their bytes confirms or clears each one. Copies meet in the
   map-side combine, so a huge group is no hot task. All other rows are returned without having moved.

Null texts count as empty; empty texts equal one another. Of equal texts the largest doc_id stays; rows without doc_id
stay only where the group has no other. Repeated rows (same id and text) are members of one group; `deduplicate` keeps
the one whose other columns have the greatest hash, so that reruns agree however rows are partitioned. Columns other than the named two may be anything: they are carried by position in a struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_unique

#: Fingerprints that an owner merges at a time (the number of owners follows the number of rows).
OWNER_ROWS = 4_000_000
LEAST_OWNERS = 16
#: Cut suspect fingerprints are broadcast up to this number (8 bytes each), and joined by a shuffle beyond.
BROADCAST_SUSPECTS = 1_000_000


def rice_encode(values: np.ndarray, low: int, shift: int) -> bytes:
    """Gaps of ascending values from low on: quotients in unary, then remainders of `shift` bits."""
    gap = np.diff(values, prepend=np.uint64(low))
    quotient = (gap >> np.uint64(shift)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + len(gap), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    rest = ((gap[:, None] >> np.arange(shift, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([len(gap), len(unary), shift, low], np.int64)
    return head.tobytes() + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(block: bytes) -> np.ndarray:
    n, n_unary, shift, low = np.frombuffer(block, np.int64, 4)
    raw, at = np.frombuffer(block, np.uint8, offset=32), -(-n_unary // 8)
    stop = np.flatnonzero(np.unpackbits(raw[:at], count=n_unary) == 0)
    quotient = np.diff(stop, prepend=-1) - 1
    rest = np.unpackbits(raw[at:], count=n * shift).reshape(n, shift).astype(np.uint64)
    gap = (quotient.astype(np.uint64) << np.uint64(shift)) + (rest << np.arange(shift, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(gap, dtype=np.uint64) + np.uint64(low)


class Layout:
    """How many bits of a fingerprint travel, and which owner has which range."""

    def __init__(self, rows: int):
        self.bits = min(48, max(16, math.ceil(math.log2(max(rows, 2))) + 10))
        self.owners = max(LEAST_OWNERS, -(-rows // OWNER_ROWS))

    def short(self, fp: np.ndarray) -> np.ndarray:
        return fp.view(np.uint64) >> np.uint64(64 - self.bits)

    def cuts(self) -> np.ndarray:
        return (np.arange(self.owners + 1, dtype=object) * (1 << self.bits) // self.owners).astype(np.uint64)


def _blocks(layout: Layout):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            part, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(part):
                held.setdefault(int(p), []).append(fp[part == p])
        out: dict[str, list] = {"owner": [], "part": [], "block": [], "again": []}
        for p, found in held.items():
            value, count = np.unique(layout.short(np.concatenate(found)), return_counts=True)
            cuts = layout.cuts()
            at = np.searchsorted(value, cuts)
            for o in range(layout.owners):
                v = value[at[o] : at[o + 1]]
                if len(v):
                    shift = max(0, int(math.log2(max(1.0, float(cuts[o + 1] - cuts[o]) / len(v)))))
                    out["owner"].append(o)
                    out["part"].append(p)
                    out["block"].append(rice_encode(v, int(cuts[o]), shift))
                    out["again"].append(np.packbits(count[at[o] : at[o + 1]] > 1).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["owner"], pa.int32()), pa.array(out["part"], pa.int32()), pa.array(out["block"], pa.binary()), pa.array(out["again"], pa.binary())], ["owner", "part", "block", "again"])

    return emit


def _merge(blocks: pa.Table) -> pa.Table:
    """An owner's answer: for each block the bitmap of fingerprints seen more than once, in the block's order."""
    values = [rice_decode(x) for x in blocks.column("block").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool) for x, v in zip(blocks.column("again").to_pylist(), values, strict=True)]
    every = np.concatenate(values)
    _, back, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[back] > 1
    ends = np.cumsum([len(v) for v in values])
    bits = [np.packbits(shared[e - len(v) : e] | t).tobytes() for v, t, e in zip(values, twice, ends, strict=True)]
    return pa.table({"part": blocks.column("part"), "owner": blocks.column("owner"), "bits": pa.array(bits, pa.binary())})


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (block, bits): the fingerprints of each block that were seen more than once."""
    for b in batches:
        found = [np.zeros(0, np.uint64)]
        for block, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            value = rice_decode(block)
            found.append(value[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(value)).astype(bool)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["short"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_sha256, part) of every row, checkpointed; part is the partition that sent it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return cut(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("text_sha256"), F.spark_partition_id().alias("part")))


def suspects(prints: DataFrame) -> tuple[DataFrame, int, Layout]:
    """Cut fingerprints (short) that may belong to several rows (checkpointed), their number, and the layout."""
    layout = Layout(prints.count())
    blocks = cut(prints.select("part", "fp").mapInArrow(_blocks(layout), "owner int, part int, block binary, again binary"))
    bitmaps = blocks.groupBy("owner").applyInArrow(_merge, "part int, owner int, bits binary")
    found = blocks.join(bitmaps, ["part", "owner"]).select("block", "bits").mapInArrow(_flagged, "short long")
    found = cut(found.distinct())
    return found, found.count(), layout


def _near(docs: DataFrame, found: DataFrame, n: int, layout: Layout, how: str) -> DataFrame:
    """docs (fp, ...) whose cut fingerprint is, or isn't, among those found."""
    cut_fp = F.shiftrightunsigned("fp", 64 - layout.bits)
    return docs.join(F.broadcast(found) if n <= BROADCAST_SUSPECTS else found, cut_fp == F.col("short"), how)


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = fingerprints(docs, id_col, text_col)
    found, n, layout = suspects(prints)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = _near(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp")), found, n, layout, "left_semi")
    groups = texts.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = cut(groups.select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    seen = cut(_near(prints, found, n, layout, "left_semi").select("doc_id", "text_sha256"))
    joined = join_unique(seen, groups, ["text_sha256"], "group_size", seen.count())
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    joined = joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
    alone = _near(prints, found, n, layout, "left_anti")
    return joined.unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Rows that no other row's fingerprint resembles pass without a shuffle."""
    found, n, layout = suspects(fingerprints(docs, id_col, text_col))
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = F.struct(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = F.struct(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True) if c != text_col))
    last = F.struct(F.xxhash64(F.to_json(others)), F.col(text_col).isNull())  # as JSON, since maps have no hash of their own
    rows = docs.select(whole.alias("row"), text.alias("text"), F.col(id_col).alias("id"), last.alias("last"), F.xxhash64(text).alias("fp"))
    best = _near(rows, found, n, layout, "left_semi").groupBy("fp", "text").agg(F.max_by("row", F.struct(F.col("id").isNotNull(), F.col("id"), F.col("last"))).alias("row"))
    out = _near(rows, found, n, layout, "left_anti").select("row").unionByName(best.select("row"))
    return out.select(*(F.col(f"row.{k}").alias(c) for c, k in zip(docs.columns, names, strict=True)))
