"""Mixing sources to target weights by systematic sampling.

Every row of a source is expected to be taken target / source size times. Rows of a source stand in order of size and id;
the prefix sums of the expected copies, plus one random offset per source, cross an integer so many times at each row, and
the row is emitted once per crossing. Ordered by size, the sample is stratified by size, so that the words taken come
within about one document of the target.

The prefix sum is spread out: rows are range-partitioned by (source, size, id), so that a source with any share of the rows
covers many partitions; partitions count their rows per source, and the running sums of these few counts are the offsets.

Null and empty texts have size 0; a null source is a source of its own, last in order. Rows without id come first within
their size. Rows alike in source, size and id are taken for one another. An empty table gives an empty mix. Other
columns may have any names, but no maps among rows that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
# Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    """The runs without ASCII white space of a whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_counts(docs: DataFrame, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """keep (new name: old name) and `size`."""
    keep = keep or {"doc_id": "doc_id", "source": "source"}
    return docs.select(*(F.col(old).alias(new) for new, old in keep.items()), word_count(F.col(text_col)).alias("size"))


def targets(sizes: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): weights by order of source, `share` of all words, each at most `most` times its size.

    Filling up by weight and resharing what is above a cap ends where every open source has the same words per weight.
    Sources are taken by ascending cap per weight: one is capped as long as what is left would give it more than its cap.
    All comparisons are between whole numbers. The frame has a row per source.
    """
    common = int(np.lcm.reduce(weights))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNotNull().desc(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    everyone = Window.partitionBy()
    filled = Window.orderBy((F.col("source_size") * (F.lit(common) / F.col("weight")).cast("long")), F.col("source").isNotNull().desc(), "source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    num, den = share
    per = (
        per.withColumn("all_size", F.sum("source_size").over(everyone))
        .withColumn("all_weight", F.sum("weight").over(everyone))
        .withColumn("used", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("open", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", (F.col("all_size") * num - F.col("used") * den) * F.col("weight") >= F.col("source_size") * most * den * F.col("open"))
    )
    capped = F.col("capped")
    fixed = F.coalesce(F.sum(F.when(capped, F.col("source_size") * most)).over(everyone), F.lit(0))
    rest = F.coalesce(F.sum(F.when(~capped, F.col("weight"))).over(everyone), F.lit(0))
    level = (F.col("all_size") * num - fixed * den).cast("double") / den / F.greatest(rest, F.lit(1))
    return per.select("source", "source_size", F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(level * F.col("weight")).alias("target"))


def offset(source: F.Column, seed: int) -> F.Column:
    """The random start of a source, from 0 to 1: 32 bits of an MD5 of seed and source."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's rank within its source and partition; rows come sorted by source."""
    last, n = object(), 0
    for b in batches:
        rank = np.empty(b.num_rows, np.int64)
        names = b.column(b.schema.get_field_index("source")).to_pylist()
        for i, s in enumerate(names):
            n = n + 1 if s == last else 0
            rank[i], last = n, s
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], [*b.schema.names, "rank"])


def mix(sizes: DataFrame, seed: int = 7, partitions: int | None = None, most: int = 2) -> DataFrame:
    """sizes (doc_id, source, size, ...) plus source_size, target, copies and taken = copies * size."""
    spark = sizes.sparkSession
    sizes = cut(sizes)
    goal = targets(sizes, most=most)
    order = [F.col("source").isNotNull().desc(), F.col("source"), F.col("size"), F.col("doc_id")]
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = sizes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    dealt = cut(dealt.mapInArrow(_ranks, f"{kinds}, rank long").withColumn("pid", F.spark_partition_id()))
    counts = dealt.groupBy("pid", "source").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pid", "source", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("start"))
    starts = starts.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = starts.select(F.col("pid").alias("p"), F.col("source").alias("s"), "start", "source_size", "target")
    out = dealt.join(starts, (F.col("pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    k, u = F.col("start") + F.col("rank"), offset(F.col("source"), seed)
    copies = F.least(F.floor(rate * (k + 1) + u) - F.floor(rate * k + u), F.lit(most)).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("pid", "p", "s", "start", "rank")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Rows alike in id, source and text share their copies: equal rows are counted by a map-side combine and emitted together,
    and what else differs among such rows divides the copies in order of a hash of the whole row.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = F.struct(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)))
    rows = docs.select(whole.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("h"))
    key = ["doc_id", "source", "h"]
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("h"), word_count(F.col(text_col)).alias("size"))
    taken = mix(sizes, seed).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("times")).filter("copies > 0")
    taken = cut(taken.select(*(F.col(c).alias(f"t_{c}") for c in key), "copies", "times"))
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in key]
    out = rows.join(taken, same)
    once = out.filter("times = 1").select("row", F.col("copies").cast("int").alias("n"))
    kinds = out.filter("times > 1").groupBy("row", *key, "copies", "times").agg(F.count(F.lit(1)).alias("rows"))
    so_far = F.sum("rows").over(Window.partitionBy(*key).orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0))
    part = lambda end: F.floor(F.col("copies") * end / F.col("times"))
    shared = kinds.withColumn("end", so_far).select("row", (part(F.col("end")) - part(F.col("end") - F.col("rows"))).cast("int").alias("n"))
    every = once.unionByName(shared).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return every.select(*(F.col(f"row.{k}").alias(c) for c, k in zip(docs.columns, names, strict=True)))
