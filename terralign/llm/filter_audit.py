"""Filter interaction audit over a packed bitmap index.

1. Each row's failures become one bit per filter. Filters A to D look at the row's text; E asks the smallest id that has the
   same text, which comes from a map-side combine by the text's SHA-256 (equal digests count as equal texts).
2. The index is partition-wise: for each Arrow batch, bitsets of 64 rows a word for every filter, label and part. AND-NOT of
   the filters gives the rows that each subset of filters leaves, and popcounts of those with parts and labels are summed over
   batches, partitions and tasks. A subset is the prefix of some order, so the sums of 2**k subsets answer all k! orders.
3. What a step keeps, removes and loses is a difference of two such sums.

Nothing but counts is shuffled in steps 2 and 3: 2**k rows for each part and task.

Null text is the empty text; null parts are the part "". Repeated rows count each; rows alike in id and text don't make each
other fail E. Rows without id have no labels, and neither fail E nor make others fail it. Of several labels of an id, one that
says 1 suffices. An empty table has no parts, so an empty result. Other columns may have any names.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_unique

#: The filters in order of their bits.
FILTERS = "ABCDE"
# The limits of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
MARKS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Parts that a task holds the sums of before it passes them on.
HELD_PARTS = 10_000


def text_failures(text: bytes) -> int:
    """Bits 0 to 3: the failures of a UTF-8 text under A, B, C and D."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) if capitals else 0
    few = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * capitals > MOST_CAPITALS * points
    marked = len(text.translate(None, MARKS)) < len(text)
    return few | repeated << 1 | loud << 2 | marked << 3


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits = [text_failures(x.as_py()) for x in b.column(3)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bits, pa.int32())], ["doc_id", "part", "fp", "fails"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, fails) of every row, fails with a bit for each of FILTERS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("fp"), text.cast("binary").alias("raw"))
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, fp binary, fails int"
    rows = cut(rows.mapInArrow(_failures, kinds))
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    both = join_unique(rows, cut(groups), ["fp"], "times", rows.count())
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return both.select("doc_id", "part", F.when(again, F.col("fails") + (1 << 4)).otherwise(F.col("fails")).alias("fails"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc_id, ...) plus good and toxic; rows without id don't take part in the join."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    joined = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left")
    joined = joined.select(*rows.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return joined.unionByName(rows.filter("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def pack(flags: np.ndarray) -> np.ndarray:
    """Bits of (m, n) flags as (m, words) of 64 bits, zeros behind the last."""
    m, n = flags.shape
    out = np.zeros((m, -(-n // 64) * 8), np.uint8)
    out[:, : -(-n // 8)] = np.packbits(flags, axis=1)
    return out.view(np.uint64)


def survivors(filters: np.ndarray) -> np.ndarray:
    """The bitset that each subset of filters (k, words) leaves, from the subset without its highest filter by AND-NOT."""
    k, words = filters.shape
    left = np.full((1 << k, words), np.uint64(2**64 - 1))
    for subset in range(1, 1 << k):
        f = subset.bit_length() - 1
        left[subset] = left[subset ^ (1 << f)] & ~filters[f]
    return left


def _popcounts(k: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            sums = np.concatenate([*held.values(), np.zeros((0, 3), np.int64)])
            names = pa.array([p for p in held for _ in range(1 << k)], pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(1 << k, dtype=np.int32), len(held))), *(pa.array(sums[:, i]) for i in range(3))], ["part", "subset", "kept", "good", "toxic"])

        for b in batches:
            if not b.num_rows:
                continue
            named = b.column(0).dictionary_encode()
            codes, fails = named.indices.to_numpy(), b.column(1).to_numpy()
            parts = pack(codes == np.arange(len(named.dictionary))[:, None])
            labels = pack(np.stack([np.ones(len(codes), bool), *(b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))]))
            left = survivors(pack((fails >> np.arange(k)[:, None] & 1).astype(bool)))
            sums = np.zeros((len(parts), 1 << k, 3), np.int64)
            for subset in range(1 << k):
                for i in range(3):
                    sums[:, subset, i] = np.bitwise_count(parts & (left[subset] & labels[i])).sum(1)
            for name, own in zip(named.dictionary.to_pylist(), sums, strict=True):
                held[name] = held[name] + own if name in held else own
            if len(held) >= HELD_PARTS:
                yield rows()
                held.clear()
        yield rows()

    return emit


def subset_counts(rows: DataFrame, k: int) -> DataFrame:
    """(part, subset, kept, good, toxic): of rows (part, fails, good, toxic), how many pass all filters of each subset."""
    found = rows.select("part", "fails", "good", "toxic").mapInArrow(_popcounts(k), "part string, subset int, kept long, good long, toxic long")
    return found.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")))


def interactions(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the sums over subsets."""
    k, steps = len(names), []
    for order in itertools.permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[i] for i in order), "step": step, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>")
    each = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("s"))
    each = each.select("part", "s", F.inline(table))
    at = lambda subset, c: F.get("s", subset)[c]
    lost = lambda c: at(F.col("before"), c) - at(F.col("after"), c)
    only = F.col("after").bitwiseXOR(F.col("before"))
    every = (1 << k) - 1
    alone = at(F.lit(every).bitwiseXOR(only), "kept") - at(F.lit(every), "kept")
    rows = each.select("part", "filter_order", "step", "f", at(F.col("after"), "kept").alias("kept"), lost("kept").alias("removed"), (at(F.lit(0), "kept") - at(only, "kept") - lost("kept")).alias("redundant"), alone.alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "f"))).drop("f")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all orders of FILTERS."""
    rows = labelled(failures(docs, id_col, text_col, part_col), labels)
    return interactions(cut(subset_counts(rows, len(FILTERS))))
