"""Benchmark decontamination: every occurrence of test windows in documents, by Wu-Manber search over words.

The symbols of the search are words, by 64-bit hashes. Windows are WINDOW consecutive words of an item; an item of fewer words is
one window. For the windows of each length m there is a search of its own:

1. The shift table says for each block of BLOCK words how far the search may skip: m - BLOCK + 1 where no window has the block,
   else the least distance of the block from a window's end. Blocks share entries by hash, with the least shift of all.
2. A position of shift 0 ends in some window's last block. The bucket of that block holds the windows that end so, in order of
   a hash of the whole window; the hash of the words before the position picks one from it.
3. What was picked is compared word by word, then byte by byte.

Many cursors, one for each PIECE of the words of a chunk of documents, go ahead together as NumPy vectors. Documents are read where
they lie; what moves is one row for each document, with its hit words as ranges. Tables are broadcast in shards of SHARD
windows and item ids at most. A benchmark of more windows takes a scan for each shard, whatever the number of documents, and
hits are then merged by document.

Null and empty texts have no words; items without words have no windows. A null item_id marks words, but isn't listed. Rows that
share an item_id are one item; repeated rows of docs are returned each. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, cut, mix64

WINDOW = 10
BLOCK = 2
# Fixed value: a word, after A-Z have become a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows and item ids of a shard, some 150 bytes each.
SHARD = 300_000
#: Ends of windows that a cursor goes over; words that are searched at a time; bytes that are hashed at a time.
PIECE, CHUNK, SLICE = 1024, 1_000_000, 1 << 20
_BASE = np.uint64(0xD6E8FEB86659FD93)
SPANS = "array<struct<first:long,end:long>>"


class ContentWords(WordHasher):
    """Hashes of words in the sense of WORD; texts of any length, SLICE bytes at a time."""

    def __init__(self) -> None:
        super().__init__()
        self.space[:] = True
        for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
            self.space[low:high] = False

    def slices(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(offset, slice) of slices that no word reaches across."""
        at, raw = 0, np.frombuffer(text, np.uint8)
        while len(text) - at > SLICE:
            end = at + SLICE
            while end < len(text) and not (gaps := self.space[raw[end : end + SLICE]]).any():
                end += SLICE
            end = min(len(text), end + int(gaps.argmax())) if end < len(text) else len(text)
            yield at, text[at:end]
            at = end
        if at < len(text):
            yield at, text[at:]

    def hashes(self, text: bytes) -> np.ndarray:
        if len(text) <= SLICE:
            return self(text)
        return np.concatenate([self(part) for _, part in self.slices(text)])

    def places(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        edges = []
        for at, part in self.slices(text):
            gap = self.space[np.frombuffer(part, np.uint8)]
            edges.append(at + np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1))))
        edge = np.concatenate(edges)
        return edge[::2], edge[1::2]


def _blocks(words: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the size words up to each end."""
    total = words[end]
    for i in range(1, size):
        total = total + words[end - i] * np.uint64(pow(int(_BASE), i, 1 << 64))
    return mix64(total)


class Table:
    """Shift table and buckets of windows that have m words each."""

    def __init__(self, m: int, shift: np.ndarray, keys: np.ndarray, words: np.ndarray, texts: list[bytes], items: list[list[str]]):
        self.m, self.shift, self.keys, self.words, self.texts, self.items = m, shift, keys, words, texts, items
        self.size = min(BLOCK, m)
        self.bits = len(shift).bit_length() - 1

    @staticmethod
    def of(m: int, texts: list[bytes], items: list[list[str]], hasher: ContentWords) -> tuple:
        """What __init__ takes, made from the windows' texts."""
        words = np.stack([hasher(t) for t in texts])
        size, flat = min(BLOCK, m), words.ravel()
        ends = np.arange(len(texts)) * m
        bits = min(24, max(8, int(8 * len(texts)).bit_length()))
        shift = np.full(1 << bits, m - size + 1, np.uint8)
        for j in range(size - 1, m):
            np.minimum.at(shift, _blocks(flat, ends + j, size) >> np.uint64(64 - bits), m - 1 - j)
        keys = Table.keys_of(flat, ends + m - 1, m, bits)
        order = np.argsort(keys, kind="stable")
        return m, shift, keys[order], words[order], [texts[i] for i in order], [items[i] for i in order]

    @staticmethod
    def keys_of(words: np.ndarray, end: np.ndarray, m: int, bits: int) -> np.ndarray:
        """Bucket of the last block, then the hash of the window."""
        bucket = _blocks(words, end, min(BLOCK, m)) >> np.uint64(64 - bits)
        return bucket << np.uint64(64 - bits) | _blocks(words, end, m) >> np.uint64(bits)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Positions whose block has no shift."""
        at = np.arange(self.m - 1, len(words), PIECE)
        stop, found, down = np.minimum(at + PIECE, len(words)), [np.zeros(0, np.int64)], np.uint64(64 - self.bits)
        while len(at):
            step = self.shift[_blocks(words, at, self.size) >> down]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            open_ = at < stop
            at, stop = at[open_], stop[open_]
        return np.concatenate(found)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the last word, number of the window) where all words agree by their hashes."""
        at = self.candidates(words)
        key = self.keys_of(words, at, self.m, self.bits)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        times = high - low
        at, which = np.repeat(at, times), np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        same = np.ones(len(at), bool)
        for i in range(self.m):
            same &= words[at - i] == self.words[which, self.m - 1 - i]
        return at[same], which[same]


def _ranges(marks: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(marks.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


class Search:
    def __init__(self, tables: list[tuple]):
        self.tables = [Table(*t) for t in tables]
        self.hasher = ContentWords()

    def hits(self, texts: list[bytes], words: list[np.ndarray]) -> Iterator[tuple[int, list[dict], list[str]]]:
        """(text, ranges of hit words, items) of the texts with occurrences."""
        gap = np.zeros(1, np.uint64)  # between texts, so that no window reaches across
        line = np.concatenate([x for w in words for x in (w, gap)])
        start = np.cumsum([0, *(len(w) + 1 for w in words)])
        found: dict[int, list[tuple[Table, int, int]]] = {}
        for table in self.tables:
            at, which = table.find(line)
            for text, end, k in zip(np.searchsorted(start, at, "right") - 1, at, which, strict=True):
                found.setdefault(int(text), []).append((table, int(end - start[text]), int(k)))
        for i, some in found.items():
            first, end = self.hasher.places(texts[i])
            mark, items = np.zeros(len(first), bool), set()
            for table, last, k in some:
                own = range(last - table.m + 1, last + 1)
                if b" ".join(texts[i][first[j] : end[j]].lower() for j in own) == table.texts[k]:
                    mark[own.start : own.stop] = True
                    items.update(table.items[k])
            if mark.any():
                yield i, _ranges(mark), sorted(items)

    def batch(self, texts: list[bytes]) -> tuple[list[int], list[list], list[list]]:
        counts, spans, items = [0] * len(texts), [[] for _ in texts], [[] for _ in texts]
        held: list[tuple[int, np.ndarray]] = []
        room = CHUNK
        for i, text in enumerate(texts):
            words = self.hasher.hashes(text)
            counts[i] = len(words)
            held.append((i, words))
            room -= len(words)
            if room <= 0 or i + 1 == len(texts):
                for k, ranges, names in self.hits([texts[j] for j, _ in held], [w for _, w in held]):
                    spans[held[k][0]], items[held[k][0]] = ranges, names
                held, room = [], CHUNK
        return counts, spans, items


def _scan(shipped):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shipped.value)
        for b in batches:
            counts, spans, items = search.batch(b.column(2).to_pylist())
            ranges = pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), ranges, pa.array(items, pa.list_(pa.string()))], ["doc_id", "key", "n_words", "spans", "items"])

    return emit


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, m, items): the distinct windows, words joined by spaces, with the ids that have them."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col(id_col).cast("string").alias("id"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    each = words.select("id", F.least(F.size("w"), F.lit(WINDOW)).alias("m"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, WINDOW), " "))).alias("window"))
    return each.groupBy("window", "m").agg(F.collect_set("id").alias("items"))


def _shipped(part: DataFrame, hasher: ContentWords):
    rows = part.toArrow()
    by: dict[int, tuple[list, list]] = {}
    for window, m, items in zip(*(rows.column(c).to_pylist() for c in ("window", "m", "items")), strict=True):
        texts, names = by.setdefault(m, ([], []))
        texts.append(window.encode())
        names.append(items)
    return part.sparkSession.sparkContext.broadcast([Table.of(m, *by[m], hasher) for m in sorted(by)])


def _merged(spans: F.Column) -> F.Column:
    """Ranges that overlap or touch become one; spans are in order."""
    start = F.expr(f"cast(array() AS {SPANS})")

    def step(done: F.Column, x: F.Column) -> F.Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["first"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, start, step)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (ranges of hit words, the end exclusive), items (sorted ids) of every row of docs."""
    found = cut(item_windows(items).withColumn("weight", F.size("items") + 1))
    shards = max(1, -(-int(found.agg(F.sum("weight").alias("n")).first()["n"] or 0) // SHARD))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text) if shards > 1 else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), text.cast("binary").alias("raw"))
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, n_words long, spans {SPANS}, items array<string>"
    hasher, rounds = ContentWords(), []
    for s in range(shards):
        part = found.filter(F.pmod(F.xxhash64("window"), F.lit(shards)) == s)
        rounds.append(rows.mapInArrow(_scan(_shipped(part, hasher)), kinds))
    if shards == 1:
        return rounds[0].drop("key")
    rounds = [cut(r) for r in rounds]
    hits = reduce(DataFrame.unionByName, rounds).filter(F.size("spans") > 0).drop("n_words").distinct()
    hits = hits.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = rounds[0].select("doc_id", "key", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() AS {kind})"))
    return both.select("doc_id", "n_words", none(_merged(F.col("spans")), SPANS).alias("spans"), none(F.col("items"), "array<string>").alias("items"))
