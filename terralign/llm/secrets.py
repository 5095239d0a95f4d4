"""Secret scans over an incremental ledger of blobs. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger has a row per (blob, rule_version) that
was ever scanned, with its findings. `update` hashes all versions where they lie and asks the ledger for the hashes alone; only
texts of blobs that it lacks at this rule version are fetched, each scanned once however many paths and versions hold it.
`findings` joins the ledger back to all paths.

Rules, each leftmost and without overlaps: assign, access and hex (see RULES); a match that is too short is dropped after
matching, so it still uses up its characters. Spans count code points, the end exclusive. Positions come from the pieces
between matches: a match ends where the pieces and matches up to it end, by a running sum over the matches of a blob.

Null text is the empty blob, which has no findings. Paths may repeat and be null, and the ledger may hold a pair repeatedly. A
huge group of equal texts meets in the map-side combine of the grouping by blob; its findings are broadcast to its paths (at
most common.HOT such groups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_unique

# The patterns of the rules, in order of rank for spans that start together; the group whose length counts
# and its least length. For access and hex the length is part of the pattern: a run is maximal, so the matches are the same.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RULES = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
RULE_VERSION = "base-1"

#: Unseen blobs, or else those seen before, are broadcast to the texts up to this number (64 bytes each); beyond it texts are
#: combined, shuffled and joined.
BROADCAST_BLOBS = 100_000

LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, spans string"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def _blob(text_col: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _matches(text: F.Column, pattern: str, group: int) -> F.Column:
    """The array of (gap, size, measured) of a rule: characters since the last match, of the match, and of what counts."""
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    size = F.transform(whole, F.length)
    measured = F.transform(F.regexp_extract_all(text, regex, F.lit(group)), F.length) if group else size
    gap = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(whole))
    none = F.expr("cast(array() as array<struct<gap:int,size:int,measured:int>>)")
    return F.when(F.regexp(text, regex), F.arrays_zip(gap.alias("gap"), size.alias("size"), measured.alias("measured"))).otherwise(none)


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, n_assign, n_access, n_hex, spans) of blobs (blob, text), those without findings left out."""
    rules = [F.struct(F.lit(i).alias("rank"), F.lit(name).alias("name"), F.lit(least).alias("least"), _matches(F.col("text"), pattern, group).alias("found")) for i, (name, pattern, group, least) in enumerate(RULES)]
    each = blobs.select("blob", F.explode(F.array(*rules)).alias("r")).filter(F.size("r.found") > 0)
    each = each.select("blob", "r.rank", "r.name", "r.least", F.posexplode("r.found").alias("i", "m"))
    so_far = Window.partitionBy("blob", "rank").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(so_far)
    hits = each.repartition("blob").withColumn("end", end).filter(F.col("m.measured") >= F.col("least"))
    span = F.struct((F.col("end") - F.col("m.size")).alias("start"), "rank", "end", "name")
    counts = [F.count_if(F.col("name") == name).alias(f"n_{name}") for name, *_ in RULES]
    found = hits.groupBy("blob").agg(*counts, F.array_sort(F.collect_list(span)).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")
    return found.select("blob", *(f"n_{name}" for name, *_ in RULES), text.alias("spans"))


def known(ledger: DataFrame, rule_version: str) -> DataFrame:
    return ledger.filter(F.col("rule_version") == rule_version).dropDuplicates(["blob"])


def update(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger with the blobs of versions that it lacked at this rule version, scanned."""
    ledger = empty_ledger(versions.sparkSession) if ledger is None else ledger
    seen = cut(versions.select(_blob(text_col).alias("blob")).distinct())
    unseen = cut(seen.join(known(ledger, rule_version).select("blob"), "blob", "left_anti"))
    n_seen, n_unseen = seen.count(), unseen.count()
    texts = versions.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blob = F.sha2("text", 256)
    if n_unseen <= BROADCAST_BLOBS:
        contents = texts.withColumn("blob", blob).join(F.broadcast(unseen), "blob", "left_semi").select("text").distinct()
    elif n_seen - n_unseen <= BROADCAST_BLOBS:
        held = F.broadcast(seen.join(unseen, "blob", "left_anti"))
        contents = texts.withColumn("blob", blob).join(held, "blob", "left_anti").select("text").distinct()
    else:
        contents = texts.distinct().withColumn("blob", blob).join(unseen, "blob", "left_semi").select("text")
    contents = contents.withColumn("blob", blob)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    fresh = unseen.join(scan(contents), "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), *(count(f"n_{name}") for name, *_ in RULES), F.coalesce("spans", F.lit("")).alias("spans"))
    return ledger.unionByName(cut(fresh))


def findings(versions: DataFrame, ledger: DataFrame, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, n_assign, n_access, n_hex, spans) of every row of versions, whose blobs the ledger knows."""
    paths = cut(versions.select(F.col(path_col).alias(path_col), _blob(text_col).alias("blob")))
    held = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("paths")).join(known(ledger, rule_version).drop("rule_version"), "blob")
    return join_unique(paths, cut(held), ["blob"], "paths", paths.count()).drop("paths")


def scan_incremental(versions: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """The findings of every row of versions, and the updated ledger."""
    ledger = update(versions, ledger, text_col, rule_version)
    return findings(versions, ledger, path_col, text_col, rule_version), ledger
