import re
from collections import defaultdict

import numpy as np
import pytest

from terralign.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    held = defaultdict(set)
    for i, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            held[tuple(w[k : k + 10])].add(i)
    sizes = {len(x) for x in held}
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in held:
                    hit.update(range(k, k + m))
                    found |= held[x]
        out.append((i, len(w), len(hit), ",".join(sorted(str(x) for x in found - {None}))))
    return out


def tables():
    rng = np.random.default_rng(11)
    vocabulary = ["a", "Bé", "c3", "ddd", "ÉE", "f" * 40, "日本", "🙂x"]
    text = lambda n: " ".join(vocabulary[int(k)] for k in rng.integers(0, len(vocabulary), n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 60, 40))]
    items += [(40, "zq zr"), (41, "zq"), (41, "zs, ZT! zu"), (None, "nobody knows"), (42, None), (43, "...")]
    items += [(50 + i, "shared words of " + items[0][1] + " ever and ever") for i in range(5)]
    docs = [(None, items[3][1])]
    for i in range(300):
        parts = [text(int(rng.integers(0, 80)))]
        for _ in range(int(rng.integers(0, 3))):
            w = words_of(items[int(rng.integers(0, len(items)))][1])
            cut = sorted(int(x) for x in rng.integers(0, len(w) + 1, 2))
            parts += ["-".join(w[cut[0] : cut[1]]), text(int(rng.integers(0, 9)))]
        docs.append((i, " / ".join(parts).upper() if i % 7 == 0 else " ".join(parts)))
    docs += [(300, None), (301, ""), (302, "zq\x00zr"), (303, "zqzr"), (304, "Nobody\tknows zs zt  zu"), (5, docs[6][1]), (5, docs[6][1])]
    docs += [(400, " ".join([docs[9][1]] * 300)), (401, "x" * 70_000 + " " + (items[8][1] or ""))]
    return docs, items


@pytest.mark.parametrize(("shard", "piece", "chunk", "slice_"), [(300_000, 1024, 1_000_000, 1 << 20), (60, 7, 200, 500)])
def test_equals_brute_force(spark, monkeypatch, shard, piece, chunk, slice_):
    for name, value in (("SHARD", shard), ("PIECE", piece), ("CHUNK", chunk), ("SLICE", slice_)):
        monkeypatch.setattr(decontaminate, name, value)
    docs, items = tables()
    frame = spark.createDataFrame([(*d, "clash", 0) for d in docs], "doc_id long, text string, items string, key int").repartition(3)
    got = decontaminate.contaminated(frame, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, window string")).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s.end - s.first for s in r.spans), ",".join(r.items)) for r in got), key=repr) == sorted(brute(docs, items), key=repr)
    assert all(a.end < b.first for r in got for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_search_skips(monkeypatch):
    hasher = decontaminate.ContentWords()
    table = decontaminate.Table(*decontaminate.Table.of(10, [b"a b c d e f g h i j"], [["1"]], hasher))
    text = b" ".join(b"w%d" % i for i in range(9000)) + b" a b c d e f g h i j end"
    words, seen, blocks = hasher(text), [], decontaminate._blocks
    monkeypatch.setattr(decontaminate, "_blocks", lambda w, end, size: (seen.append(len(end)), blocks(w, end, size))[1])
    at, which = table.find(words)
    assert at.tolist() == [9009] and which.tolist() == [0] and sum(seen) < 2 * len(words) / 9


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "item_id long, text string")
    (r,) = decontaminate.contaminated(docs, items.limit(0)).collect()
    assert (r.n_words, r.spans, r.items) == (2, [], [])
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
