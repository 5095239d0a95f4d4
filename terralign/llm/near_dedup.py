"""Near-duplicates of word shingles by a multi-index Hamming join of b-bit MinHash signatures.

1. Rows with equal shingle sets (a 128-bit digest of the set) form a class; its least doc_id stands for it.
2. A class has a signature of SYMBOLS symbols, each BITS bits of a minimum hash. A pair at the least similarity linked
   differs in a fifth of the symbols on average; RADIUS is where all but some 4e-6 of such pairs lie.
3. The symbols are split into CHUNKS chunks with CHUNKS * (ERRORS + 1) > RADIUS, so any pair within the radius has a chunk
   with ERRORS errors at most. A chunk emits a key for each way to leave out ERRORS symbols: such a pair shares a key.
4. Classes that share a key are compared in blocks; pairs within the radius, or in large buckets a spanning forest of them,
   become edges, and the components of these candidates are found.
5. Every component's full shingle sets are fetched once, and all its pairs are decided on the sets themselves, by an
   inverted index and, for shingles that many hold, a matrix product. Components of the confirmed links are the result.

Buckets and components above BLOCK rows are dealt to tasks as pairs of blocks, so no task holds more than two blocks.

Null texts and texts without words have an empty set and are linked with nothing. Rows without doc_id are returned with a
null component and stay. doc_id names the row: rows that share one count as one node, in the component of its least link.
Ids are whole numbers. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, cut, join_unique, mix64, windows
from .components import components

SYMBOLS, BITS, RADIUS, CHUNKS, ERRORS = 64, 16, 28, 15, 1
assert CHUNKS * (ERRORS + 1) > RADIUS and ERRORS == 1
BLOCK = 4096
#: Candidate ids are broadcast up to this number (16 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000

_ODD = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FLIP = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_EDGES = [round(i * SYMBOLS / CHUNKS) for i in range(CHUNKS + 1)]


def shingles(hasher: WordHasher, text: str | None, n: int) -> np.ndarray:
    """The ascending hashes of a text's distinct n-word shingles."""
    return np.unique(windows(hasher(text.encode() if text else b""), n))


def signature(values: np.ndarray) -> bytes:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 8192):
        part = (values[None, i : i + 8192] ^ _FLIP[:, None]) * _ODD[:, None]
        np.minimum(least, part.min(1), out=least)
    return (mix64(least) >> np.uint64(64 - BITS)).astype(np.uint16).tobytes()


def _describe(n: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            size, one, two, sig = [], [], [], []
            for text in b.column(1).to_pylist():
                values = shingles(hasher, text, n)
                size.append(len(values))
                one.append(int(mix64(values).sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(np.bitwise_xor.reduce(mix64(values ^ np.uint64(0x5BF03635))).astype(np.int64)) if len(values) else 0)
                sig.append(signature(values) if len(values) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set1", "set2", "sig"])

    return emit


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = (np.arange(SYMBOLS, dtype=np.uint64) + np.uint64(1)) << np.uint64(32)
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            b = whole.slice(at, 4096)
            term = mix64(_matrix(b.column(1)).astype(np.uint64) + place)
            key = np.empty_like(term)
            for lo, hi in pairwise(_EDGES):
                key[:, lo:hi] = term[:, lo:hi].sum(1, dtype=np.uint64)[:, None] - term[:, lo:hi]
            key = mix64(key + place).view(np.int64)
            ids = np.repeat(b.column(0).to_numpy(), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(ids)], ["key", "id"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, id) sorted by key: the rows whose key another row has, with their block within the key."""
    held_key, held_id, run = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def out(key: np.ndarray, ids: np.ndarray, before: int, last: bool):
        """before: how many rows of key[0] went before; the last row waits unless it is the last of all."""
        n = len(key) - (not last)
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        rank = np.arange(len(key)) - np.repeat(edge, np.diff(np.r_[edge, len(key)]))
        rank[: edge[1] if len(edge) > 1 else len(key)] += before
        same = np.r_[key[1:] == key[:-1], False]
        keep = ((rank > 0) | same)[:n]
        block = (rank[:n] // BLOCK).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key[:n][keep]), pa.array(ids[:n][keep]), pa.array(block[keep])], ["key", "id", "block"]), int(rank[-1])

    for b in batches:
        if not b.num_rows:
            continue
        key, ids = np.r_[held_key, b.column(0).to_numpy()], np.r_[held_id, b.column(1).to_numpy()]
        batch, run = out(key, ids, run, False)
        held_key, held_id = key[-1:], ids[-1:]
        yield batch
    if len(held_key):
        yield out(held_key, held_id, run, True)[0]


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component, for edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _close(sig: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    ok = 10 * np.minimum(size[i], size[j]) >= 8 * np.maximum(size[i], size[j])
    ok[ok] = (sig[i[ok]] != sig[j[ok]]).sum(1) <= RADIUS
    return ok


def _compare(ids: np.ndarray, size: np.ndarray, sig: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate edges among runs of rows that start at `start`: small runs pair by pair, in large ones a spanning forest."""
    length = np.diff(np.r_[start, len(ids)])
    left, right = [], []
    small = length <= 16
    row_end = np.repeat(start + length, length)
    row_small = np.repeat(small, length)
    for step in range(1, int(length[small].max(initial=1))):
        i = np.flatnonzero(row_small & (np.arange(len(ids)) + step < row_end))
        if len(i):
            i = i[_close(sig, size, i, i + step)]
            left.append(ids[i])
            right.append(ids[i + step])
    for s, n in zip(start[~small], length[~small], strict=True):
        found_i, found_j = [], []
        for lo in range(0, n, 256):
            part = slice(s + lo, s + min(lo + 256, n))
            apart = np.zeros((part.stop - part.start, n), np.uint8)
            for k in range(SYMBOLS):
                apart += sig[part, k][:, None] != sig[s : s + n, k][None, :]
            i, j = np.nonzero(apart <= RADIUS)
            i = i + lo
            up = (i < j) & (10 * np.minimum(size[s + i], size[s + j]) >= 8 * np.maximum(size[s + i], size[s + j]))
            found_i.append(i[up])
            found_j.append(j[up])
        label = labels_of(int(n), np.concatenate(found_i), np.concatenate(found_j))
        tied = np.flatnonzero(label != np.arange(n))
        left.append(ids[s + tied])
        right.append(ids[s + label[tied]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (task, id, n, sig) sorted by task: distinct candidate edges."""
    held: pa.Table | None = None

    def out(t: pa.Table) -> pa.RecordBatch:
        task = t.column("task").to_numpy()
        start = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        a, b = _compare(t.column("id").to_numpy(), t.column("n").to_numpy(), _matrix(t.column("sig")), start)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        task = held.column("task").to_numpy()
        if len(task) >= 4 * BLOCK and task[0] != task[-1]:
            at = int(np.searchsorted(task, task[-1]))
            yield out(held.slice(0, at))
            held = held.slice(at)
    if held is not None and held.num_rows:
        yield out(held)


def links_within(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of sets with 100 * intersection >= percent * union, decided exactly."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    value, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    edge = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    count = np.diff(np.r_[edge, len(value)])
    common = np.zeros((n, n), np.float32)
    many = np.flatnonzero(count > max(8, n // 16))
    for at in range(0, len(many), 2048):
        some = many[at : at + 2048]
        held = np.zeros((n, len(some)), np.float32)
        for c, e in enumerate(some):
            held[owner[edge[e] : edge[e] + count[e]], c] = 1
        common += held @ held.T
    for k in np.unique(count[(count > 1) & (count <= max(8, n // 16))]):
        rows = edge[count == k]
        i, j = np.triu_indices(int(k), 1)
        for at in range(0, len(rows), max(1, 2_000_000 // len(i))):
            who = owner[rows[at : at + max(1, 2_000_000 // len(i)), None] + np.arange(k)]
            flat, times = np.unique((who[:, i] * n + who[:, j]).ravel(), return_counts=True)
            common.ravel()[flat] += times
    i, j = np.nonzero(np.triu(np.maximum(common, common.T), 1))
    both = np.maximum(common[i, j], common[j, i]).astype(np.int64)
    ok = 100 * both >= percent * (size[i] + size[j] - both)
    return i[ok], j[ok]


def _confirm(percent: int):
    def of(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in t.column("values").to_pylist()]
        ids = t.column("id").to_numpy()
        a, b = links_within(sets, percent)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        label = ids[order][labels_of(len(ids), rank[a], rank[b])[rank]]
        tied = label != ids
        return pa.table({"a": pa.array(label[tied]), "b": pa.array(ids[tied])})

    return of


def _sets(n: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            values = pa.array([shingles(hasher, t, n).tobytes() for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), values], ["id", "group", "values"])

    return emit


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, block, ...) with `task`: rows of keys of several blocks go to a task for each pair of blocks with theirs."""
    large = rows.filter("block > 0").groupBy(key).agg((F.max("block") + 1).alias("blocks"))
    if large.isEmpty():
        return rows.withColumn("task", F.col(key))
    rows = rows.join(large, key, "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    pair = F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))
    return rows.withColumn("task", F.when(F.col("blocks").isNull(), F.col(key)).otherwise(pair)).drop("blocks", "other")


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept. RADIUS holds for links of 80 percent or more."""
    if percent < 80:
        raise ValueError("candidates are searched for similarities of 80 percent or more")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = cut(texts.mapInArrow(_describe(words), "doc_id long, n_shingles long, set1 long, set2 long, sig binary"))
    full = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "set1", "set2"]
    classes = cut(full.groupBy(*same).agg(F.min_by(F.struct("doc_id", "sig"), "doc_id").alias("x"), F.count(F.lit(1)).alias("members")).select(*same, "x.doc_id", "x.sig", "members"))

    keys = classes.select("doc_id", "sig").mapInArrow(_keys, "key long, id long").repartition("key").sortWithinPartitions("key")
    shared = cut(keys.mapInArrow(_shared, "key long, id long, block int"))
    buckets = _dealt(shared, "key").select("task", "id").join(classes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig"), "id")
    buckets = buckets.select("task", "id", "n", "sig").repartition("task").sortWithinPartitions("task")
    groups = components(buckets.mapInArrow(_candidates, "a long, b long"))

    members = cut(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group")))
    n_members = members.count()
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    chosen = texts.join(F.broadcast(members) if n_members <= BROADCAST_IDS else members, "doc_id")
    sets = chosen.select(F.col("doc_id").alias("id"), "group", "text").mapInArrow(_sets(words), "id long, group long, values binary")
    if sizes.isEmpty():
        sets = sets.withColumn("task", F.col("group"))
    else:
        blocks = sizes.select("group", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("k"))
        sets = sets.join(blocks, "group", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("k")), F.lit(0)).cast("int")).drop("k")
        sets = _dealt(sets, "group")
    links = sets.select("task", "id", "values").groupBy("task").applyInArrow(_confirm(percent), "a long, b long")

    found = components(links).withColumnRenamed("node", "doc_id")
    leaders = classes.select(*same, F.col("doc_id").alias("rep"), "members").join(found.withColumnRenamed("doc_id", "rep"), "rep", "left")
    leaders = cut(leaders.select(*same, F.coalesce("component", "rep").alias("component"), "members"))
    placed = join_unique(full.select("doc_id", *same), leaders, same, "members", described.count()).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    rest = described.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.when(F.col("n_shingles") >= 0, F.col("doc_id")).alias("component_id"))
    return placed.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, all columns: of each component the row with its least doc_id; of rows equal in id and text one."""
    found = cut(resolve(docs, id_col, text_col, words, percent).select("doc_id", "kept"))
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = F.struct(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)))
    rows = docs.select(whole.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def near(ids: DataFrame, how: str, of: DataFrame) -> DataFrame:
        return of.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("id") == F.col("gone"), how)

    left = near(cut(gone), "left_anti", rows)
    again = cut(found.filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("gone")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gone"))
    if not again.isEmpty():
        one = near(again, "left_semi", left).groupBy("id", "text").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        left = near(again, "left_anti", left).select("row").unionByName(one.select("row"))
    return left.select(*(F.col(f"row.{k}").alias(c) for c, k in zip(docs.columns, names, strict=True)))
