"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

The trusted rows are those whose labels say quality 1 and never otherwise; one in HELD of them, by a hash of the id, is kept
back for the limits, and all others are counted, whole. Partitions count runs of ORDER characters, of any character there is,
with PAD before a text; the counts are summed as rows of a DataFrame, and joins of the counts with those of their contexts and
suffixes give discounted probabilities and back-off weights:

    p(d|abc) = (n(abcd) - D) / n(abc.) + g(abc) * p(d|bc),   and likewise for shorter contexts from continuation counts,

with three discounts per order from the counts of counts. A character that was never counted has the share of one more symbol.

What a run adds to the logarithm beyond its context's weight and its own suffix is a sum over the runs in a text: each run
seen adds log p(d|abc) - log g(abc) - log p(d|bc) where it ends, and log g of a run where it is a context. So a document's
log-probability is the sum of its runs' weights, and the table of weights, which grows with the trusted text, is joined in
shards: a round for each shard of SHARD rows, sent to all tasks, adds up the weights of the runs that each text shares with
it, and the sums of the rounds are added by document. Texts are not shuffled.

A document's limits come from quantiles of log-perplexity over the trusted documents of its language, those kept back and all,
whichever are wider: the median plus SLACK times the distance from the median to the 0.99 quantile, and the median
minus SLACK times that to the 0.01 quantile; text that is far more likely than any trusted one is a repetition. Both distances
grow with the square root of SHORT / length for texts of under SHORT characters, whose means scatter more. Languages without
trusted rows have the limits of all.

Null and empty texts have no perplexity and are rejected. A null language is a language of its own. Without any trusted
row there is no model: perplexities are null, and all texts but empty ones are accepted. Repeated rows are scored alike.
Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64

ORDER = 4
HELD = 8
SLACK = 2.5
SHORT = 2000
PAD = 0x110000
#: Rows of a shard of the table of weights (24 bytes each), and characters that are looked up at a time.
SHARD, PIECE = 1_000_000, 1_000_000
#: Trusted ids are broadcast up to this number (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_CODES = [f"c{i}" for i in range(1, ORDER + 1)]


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__trusted"))


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Code points of texts, some PIECE at a time, each piece behind the ORDER - 1 symbols before it; (text, place, size) of each."""
    held, spans, n = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        line = np.r_[np.full(ORDER - 1, PAD, np.uint32), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        for at in range(ORDER - 1, len(line), PIECE):
            part = line[at - ORDER + 1 : at + PIECE]
            held.append(part)
            spans.append((i, n + ORDER - 1, len(part) - ORDER + 1))
            n += len(part)
            if n >= PIECE:
                yield np.concatenate(held), spans
                held, spans, n = [], [], 0
    if held:
        yield np.concatenate(held), spans


def run_keys(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each length from 1 to ORDER the hashes of the runs that end at each place (meaningless where none fits)."""
    one = codes.astype(np.uint64) + np.uint64(1)
    total = one.copy()
    for k in range(1, ORDER + 1):
        if k > 1:
            total[k - 1 :] += one[: len(one) - k + 1] * np.uint64(pow(_BASE, k - 1, 1 << 64))
        yield mix64(total + np.uint64(k))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c1 ... c4, n): the runs of ORDER characters of a partition."""
    key, codes, n = np.zeros(0, np.uint64), np.zeros((0, ORDER), np.int32), np.zeros(0, np.int64)
    for b in batches:
        for line, spans in pieces(b.column(0).to_pylist()):
            *_, keys = run_keys(line)
            at = np.concatenate([np.arange(place, place + size) for _, place, size in spans])
            some, first, times = np.unique(keys[at], return_index=True, return_counts=True)
            found = line[at[first][:, None] + np.arange(1 - ORDER, 1)].astype(np.int32)
            key, first, back = np.unique(np.r_[key, some], return_index=True, return_inverse=True)
            codes, n = np.concatenate([codes, found])[first], np.bincount(back, np.r_[n, times], len(key)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(codes[:, i])) for i in range(ORDER)), pa.array(n)], [*_CODES, "n"])


def _discounted(counts: DataFrame, context: list[str]) -> DataFrame:
    """counts plus share, the discounted part of n in its context, and back, the context's back-off weight."""
    of = counts.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (max(1, of[f"n{k}"]) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [min(max(x, 0.1), k) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
    less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    sums = [F.sum("n").alias("all"), F.sum(less).alias("freed")]
    whole = counts.groupBy(*context).agg(*sums).withColumn("back", F.col("freed") / F.col("all")) if context else None
    if whole is None:
        one = counts.agg(*sums).first()
        return counts.select("*", ((F.col("n") - less) / one["all"]).alias("share"), F.lit(one.freed / one["all"]).alias("back"))
    return counts.join(whole, context).select(*counts.columns, ((F.col("n") - less) / F.col("all")).alias("share"), "back")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, c1 ... c4, event, back): the key of the last k codes."""
    for b in batches:
        length = b.column(0).to_numpy()
        codes = np.stack([b.column(i).to_numpy() for i in range(1, ORDER + 1)], 1)
        key = np.zeros(len(length), np.uint64)
        for k in np.unique(length):
            rows = np.flatnonzero(length == k)
            flat = np.ascontiguousarray(codes[rows, ORDER - k :]).ravel().astype(np.uint32)
            key[rows] = list(run_keys(flat))[k - 1][k - 1 :: k] if len(flat) >= k else 0
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(ORDER + 1), b.column(ORDER + 2)], ["key", "event", "back"])


def train(texts: DataFrame) -> tuple[DataFrame, float] | None:
    """The weights (key, event, back), checkpointed, and the log-probability of an unknown character; None without a character."""
    grams = cut(texts.mapInArrow(_count, ", ".join([*(f"{c} int" for c in _CODES), "n long"])).groupBy(*_CODES).agg(F.sum("n").alias("n")))
    if grams.isEmpty():
        return None
    levels = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = cut(levels[k + 1].groupBy(*_CODES[ORDER - k :]).agg(F.count(F.lit(1)).alias("n")))
    out, lower, unknown = [], None, 0.0
    for k in range(1, ORDER + 1):
        mine = _CODES[ORDER - k :]
        counts = _discounted(levels[k], mine[:-1])
        if k == 1:
            base = counts.agg(F.count(F.lit(1)).alias("n"), F.first("back").alias("back")).first()
            unknown = base.back / (base.n + 1)
            counts = counts.withColumn("p", F.col("share") + unknown).withColumn("event", F.log("p") - float(np.log(unknown)))
        else:
            counts = counts.join(lower, mine[1:]).withColumn("p", F.col("share") + F.col("back") * F.col("below"))
            counts = counts.withColumn("event", F.log("p") - F.log("back") - F.log("below"))
            context = counts.groupBy(*mine[:-1]).agg(F.first("back").alias("back"))
            moved = [F.lit(0).alias(c) for c in _CODES[: ORDER - k + 1]] + [F.col(c).alias(d) for c, d in zip(mine[:-1], _CODES[ORDER - k + 1 :], strict=True)]
            out.append(context.select(F.lit(k - 1).alias("k"), *moved, F.lit(0.0).alias("event"), F.log("back").alias("back")))
        counts = cut(counts.select(*mine, "p", "event"))
        out.append(counts.select(F.lit(k).alias("k"), *(F.lit(0).alias(c) for c in _CODES[: ORDER - k]), *mine, "event", F.lit(0.0).alias("back")))
        lower = counts.select(*mine, F.col("p").alias("below"))
    keyed = reduce(DataFrame.unionByName, out).mapInArrow(_keyed, "key long, event double, back double")
    return cut(keyed.groupBy("key").agg(F.sum("event").alias("event"), F.sum("back").alias("back"))), float(np.log(unknown))


class Weights:
    """A shard of the table of weights, found by the leading bits of a key."""

    def __init__(self, key: np.ndarray, event: np.ndarray, back: np.ndarray):
        key = key.view(np.uint64)
        order = np.argsort(key)
        self.key = np.r_[key[order], np.uint64(2**64 - 1)]
        self.event, self.back = np.r_[event[order], 0.0], np.r_[back[order], 0.0]
        bits = max(4, int(4 * len(key)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.key[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places among keys that the shard has, and where in the shard."""
        at = self.first[keys >> self.shift]
        open_ = np.flatnonzero(self.key[at] < keys)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.key[at[open_]] < keys[open_]]
        hit = np.flatnonzero(self.key[at] == keys)
        return hit, at[hit]

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """The weights of all runs of each text that the shard has."""
        out = np.zeros(len(texts))
        for line, spans in pieces(texts):
            event, back = np.zeros(len(line) + 1), np.zeros(len(line) + 1)
            for k, keys in enumerate(run_keys(line), 1):
                hit, at = self.find(keys)
                event[hit + 1] += self.event[at]
                if k < ORDER:
                    back[hit + 1] += self.back[at]
            event, back = np.cumsum(event), np.cumsum(back)
            for i, place, size in spans:
                out[i] += event[place + size] - event[place] + back[place + size - 1] - back[place - 1]
        return out


def _partial(shipped):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*shipped.value)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            size = [len(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size, pa.int64()), pa.array(weights.sums(texts))], [*b.schema.names[:-1], "n", "part"])

    return emit


def log_probability(rows: DataFrame, table: DataFrame, unknown: float) -> DataFrame:
    """rows (doc_id, lang, row_key, text), with n (characters) and nll, the mean negative log-probability, in place of text."""
    shards = max(1, -(-table.count() // SHARD))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.drop("text").dtypes) + ", n long, part double"
    rounds = []
    for s in range(shards):
        t = table.filter(F.pmod("key", F.lit(shards)) == s).toArrow()
        shipped = rows.sparkSession.sparkContext.broadcast(tuple(t.column(c).to_numpy() for c in ("key", "event", "back")))
        rounds.append(rows.mapInArrow(_partial(shipped), kinds))
    same = [*rows.drop("text").columns, "n"]
    if shards == 1:
        total = rounds[0]
    else:  # repeated rows have equal sums
        total = reduce(DataFrame.unionByName, rounds).groupBy(*same).agg((F.sum("part") * shards / F.count(F.lit(1))).alias("part"), F.count(F.lit(1)).alias("times"))
        total = total.withColumn("times", F.explode(F.sequence(F.lit(1), (F.col("times") / shards).cast("int"))))
    return total.select(*same, F.when(F.col("n") > 0, -F.col("part") / F.col("n") - unknown).alias("nll"))


def _near(left: DataFrame, ids: DataFrame, n: int, on: str, how: str) -> DataFrame:
    return left.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col(on) == F.col("__trusted"), how)


def limits(known: DataFrame) -> DataFrame:
    """(l, mid, low, high) of each language l among known (lang, n, nll), and of all in the row where every is true."""
    wide = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(SHORT)) / F.col("n")))
    tagged = known.select("lang", "n", "nll", F.lit(False).alias("every")).unionByName(known.select(F.lit(None).cast("string").alias("lang"), "n", "nll", F.lit(True).alias("every")))
    mid = cut(tagged.groupBy("every", F.col("lang").alias("l")).agg(F.percentile_approx("nll", 0.5, 10_000).alias("mid")))
    both = tagged.withColumnRenamed("every", "e").join(mid, (F.col("e") == F.col("every")) & F.col("lang").eqNullSafe(F.col("l")))
    far = (F.col("nll") - F.col("mid")) / wide
    reach = F.percentile_approx(far, F.array(F.lit(0.01), F.lit(0.99)), 10_000)
    return cut(both.groupBy("every", "l").agg(F.first("mid").alias("mid"), reach.alias("r")).select("every", "l", "mid", F.col("r")[0].alias("low"), F.col("r")[1].alias("high")))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, lang, n, perplexity, least, limit, accepted, row_key (a hash of id and text)."""
    spark: SparkSession = docs.sparkSession
    ids = cut(trusted_ids(labels))
    n_ids = ids.count()
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(HELD)) == 0
    trusted = _near(chosen, ids, n_ids, "doc_id", "left_semi")
    model = train(trusted.filter(~held).select("text")) or train(trusted.select("text"))
    if model is None:
        nothing = F.lit(None).cast("double")
        return chosen.select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), nothing.alias("perplexity"), nothing.alias("least"), nothing.alias("limit"), (F.coalesce("text", F.lit("")) != "").alias("accepted"), "row_key")
    scored = cut(log_probability(chosen, *model))
    known = _near(scored, ids, n_ids, "doc_id", "left_semi").filter("nll IS NOT NULL")
    wide = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(SHORT)) / F.col("n")))
    both, lows, highs = scored, [], []
    for i, part in enumerate((known.filter(held), known)):
        apart = limits(part)
        every = apart.filter("every").first()
        if every is None:
            continue
        own = apart.filter("NOT every").select(F.col("l").alias(f"l{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("mid", "low", "high")))
        both = both.join(own, F.col("lang").eqNullSafe(F.col(f"l{i}")), "left")
        mid, low, high = (F.coalesce(F.col(f"{c}{i}"), F.lit(every[c])) for c in ("mid", "low", "high"))
        lows.append(mid + SLACK * low * wide)
        highs.append(mid + SLACK * high * wide)
    both = both.withColumn("lo", F.when(F.col("n") > 0, F.least(*lows) if len(lows) > 1 else lows[0]))
    both = both.withColumn("hi", F.when(F.col("n") > 0, F.greatest(*highs) if len(highs) > 1 else highs[0]))
    good = F.coalesce(F.col("nll").between(F.col("lo"), F.col("hi")), F.lit(False))
    return both.select("doc_id", "lang", "n", F.exp("nll").alias("perplexity"), F.exp("lo").alias("least"), F.exp("hi").alias("limit"), good.alias("accepted"), "row_key")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The accepted rows, all columns. Rejected rows are known by their id and a hash of id and text."""
    bad = cut(score(docs, labels, id_col, text_col, lang_col).filter("NOT accepted").select(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).distinct())
    other = (F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad).alias("bad")
    same = F.col(f"good.`{id_col}`").eqNullSafe(F.col("bad.id")) & (F.xxhash64(F.col(f"good.`{id_col}`"), F.col(f"good.`{text_col}`")) == F.col("bad.key"))
    return docs.alias("good").join(other, same, "left_anti")
