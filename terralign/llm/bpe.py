"""Byte-level BPE encoding and decoding by ranked merges over the distinct words of a text.

A text is split by the tokenizer's pattern. A word that is in the rank map is one token; any other is folded: the state
holds the pieces and the ranks of neighbours, each step joins the leftmost pair of least rank and looks up the two ranks
next to it, until no pair has one. Decoding looks the ids up in the list of pieces and concatenates these.

Two forms give the same ids:

* `encode_native` folds with higher-order functions. Bytes travel as strings of code points 0 to 255 (ISO-8859-1); the
  rank map is a literal of the plan: an array of small maps, addressed by hash, as a lookup in one large map would scan it.
  It is right but takes some twelve times the CPU time allowed (figures in the README), and quadratic time in a word's
  bytes, so it is for texts whose words have LONG_WORD bytes at most.
* `encode_texts` is the form for whole corpora: the same fold in Arrow batches, each distinct word folded once per task as
  long as it stays among MEMO remembered words; words of over LONG_WORD bytes take a heap.

Null and empty texts have no tokens. Rows may repeat; ids may be null; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the literal rank map.
BUCKETS = 1 << 16
LONG_WORD = 200
MEMO = 300_000
_NONE = 2_147_483_647

# Fixed value: white space as the tokenizer's pattern means it, spelled out because regex engines differ on \s.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def java_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def _xxhash_buckets(spark, pieces: list[str]) -> list[int]:
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pieces)], "i int, p string")
    return [r.b for r in frame.select("i", F.pmod(F.xxhash64("p"), F.lit(BUCKETS)).cast("int").alias("b")).orderBy("i").toLocalIterator()]


class Vocabulary:
    """A rank file as literals of a plan."""

    def __init__(self, spark, path: str):
        ranks = load_ranks(path)
        names = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            names[rank] = piece.decode("latin-1")
        maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for name, bucket, rank in zip(names, _xxhash_buckets(spark, names), range(len(names)), strict=True):
            maps[bucket][name] = rank
        little = [r.to_bytes(4, "little").decode("latin-1") for r in range(len(names))]
        self.maps = self._literal(maps, "array<map<string,int>>")
        self.pieces = self._literal(names, "array<string>")
        self.little = self._literal(little, "array<string>")

    @staticmethod
    def _literal(value, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)

    def rank(self, piece: Column) -> Column:
        return F.try_element_at(F.get(self.maps, F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")), piece)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def fold_word(word: Column, vocabulary: Vocabulary) -> Column:
    """The ids of a word (a string of bytes) that isn't a token itself."""

    def rank(piece: Column) -> Column:
        return F.coalesce(vocabulary.rank(piece), F.lit(_NONE))

    def step(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def join(at: Column) -> Column:
            def put(q: Column) -> Column:
                left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), q)))).otherwise(F.expr("cast(array() as array<int>)"))
                right = F.when(at < F.size(r), F.array(rank(F.concat(q, F.get(p, at + 1))))).otherwise(F.expr("cast(array() as array<int>)"))
                pieces = F.concat(F.slice(p, F.lit(1), at - 1), F.array(q), F.slice(p, at + 2, F.size(p)))
                ranks = F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r)))
                return F.struct(pieces.alias("p"), ranks.alias("r"), (F.coalesce(F.array_min(ranks), F.lit(_NONE)) < _NONE).alias("more"))

            return _let(F.concat(F.get(p, at - 1), F.get(p, at)), put)

        return F.when(state["more"], _let(F.array_position(r, F.array_min(r)).cast("int"), join)).otherwise(state)

    def start(chars: Column) -> Column:
        pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: rank(F.concat(a, b)))
        state = _let(pairs, lambda r: F.struct(chars.alias("p"), r.alias("r"), (F.coalesce(F.array_min(r), F.lit(_NONE)) < _NONE).alias("more")))
        return F.aggregate(F.slice(chars, F.lit(2), F.size(chars)), state, step, lambda s: F.transform(s["p"], vocabulary.rank))

    return _let(F.split(word, ""), start)


def encode_native(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids as little-endian uint32, decoded bytes) of texts whose words have LONG_WORD bytes at most."""
    vocabulary = Vocabulary(docs.sparkSession, path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))
    out = docs.select(F.col(id_col).alias("doc_id"), F.transform(words, lambda w: F.decode(F.encode(w, "UTF-8"), "ISO-8859-1")).alias("words"))
    out = out.withColumn("whole", F.transform("words", vocabulary.rank))
    parted = F.filter(F.zip_with("words", "whole", lambda w, r: F.when(r.isNull(), w)), lambda w: w.isNotNull())
    out = out.withColumn("parted", F.array_distinct(parted))
    folded = F.map_from_arrays("parted", F.transform("parted", lambda w: fold_word(w, vocabulary)))
    # Bound by _let: as a column of its own the map would be inlined into the lambda and folded anew for every word.
    ids = _let(folded, lambda known: F.flatten(F.zip_with("words", "whole", lambda w, r: F.when(r.isNotNull(), F.array(r)).otherwise(F.try_element_at(known, w)))))
    return out.select("doc_id", ids.alias("ids")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.encode(F.array_join(F.transform("ids", lambda i: F.get(vocabulary.little, i)), ""), "ISO-8859-1").alias("ids"),
        F.encode(F.array_join(F.transform("ids", lambda i: F.get(vocabulary.pieces, i)), ""), "ISO-8859-1").alias("decoded"),
    )


def python_pattern(pattern: str) -> str:
    white = "".join(chr(int(x[3:-1], 16)) if x.startswith(r"\x{") else x for x in regex.findall(r"\\x\{\w+\}|\\.|.", WHITE))
    return pattern.replace(r"[^\s", f"[^{white}").replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]")


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: the leftmost pair of least rank is joined until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return fold_long(word, ranks)
    rank = ranks.get
    pieces = [word[i : i + 1] for i in range(len(word))]
    near = [rank(a + b, _NONE) for a, b in zip(pieces, pieces[1:], strict=False)]
    while near:
        least = min(near)
        if least == _NONE:
            break
        at = near.index(least)
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del near[at]
        if at:
            near[at - 1] = rank(pieces[at - 1] + pieces[at], _NONE)
        if at < len(near):
            near[at] = rank(pieces[at] + pieces[at + 1], _NONE)
    return [ranks[p] for p in pieces]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: pairs wait in a heap by rank and place, pieces are spans linked to their neighbours."""
    n = len(word)
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, stop = heapq.heappop(waiting)
        j = end[i]
        if j < 0 or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, -1
        if stop < n:
            back[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(waiting, (r, i, end[stop]))
        if back[i] >= 0 and (r := ranks.get(word[back[i] : stop])) is not None:
            heapq.heappush(waiting, (r, back[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian uint32, decoded bytes) of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # the vocabulary file, whatever the corpus
    spelled = python_pattern(pattern)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shipped.value
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        split, known = regex.compile(spelled).findall, {}

        def encode(text: str) -> bytes:
            words = split(text)
            fresh = set(words).difference(known)
            if len(known) + len(fresh) > MEMO:
                known.clear()
                fresh = set(words)
            for w in fresh:
                known[w] = b"".join(i.to_bytes(4, "little") for i in fold(w.encode(), ranks))
            return b"".join(map(known.__getitem__, words))

        def decode(ids: bytes) -> bytes:
            return b"".join(map(pieces.__getitem__, memoryview(ids).cast("I"))) if ids else b""

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [encode(t) if t else b"" for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(decode, ids), pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(emit, f"doc_id {chosen.schema[0].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")
