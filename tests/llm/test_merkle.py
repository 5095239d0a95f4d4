import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralign.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, node string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path_of(levels, at, fanout):
    for nodes in levels[:-1]:
        low = at // fanout * fanout
        yield nodes[low:at], nodes[at + 1 : low + fanout]
        at //= fanout


def brute(rows, fanout):
    by = {}
    for i, text, lang, source, n, *_ in rows:
        leaf = h(*map(value, (i, source, lang, n, text)))
        lower = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        other = h(*map(value, (i, source, lang, n, lower))) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf
        by.setdefault(source, []).append((i is not None, i or 0, leaf, other, i))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s])], fanout) for s in names}
    top = levels_of([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, other, i) in enumerate(sorted(by[s])):
            path = [*path_of(trees[s], at, fanout), *path_of(top, k, fanout)]
            node = other
            for before, after in path:
                node = h(*before, node, *after)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], h(*(x for p in path for y in p for x in y)), node, node == top[-1][0]))
    return out


def rows():
    rng = np.random.default_rng(4)
    out = [(int(i), f"Text {i} é" * int(n), ["en", None][int(i) % 2], f"s{int(min(k, 2))}" if k < 4 else None, int(n), 0, "clash") for i, n, k in zip(rng.permutation(900) - 100, rng.integers(0, 5, 900), rng.integers(0, 5, 900), strict=True)]
    out += [(5000 + i, "X", None, "é" + chr(97 + i) * 3, None, None, None) for i in range(20)]  # sources of one leaf
    out += [(None, None, None, "s1", None, 1, ""), (None, "A", None, "s1", None, 1, ""), (3, "again", "en", "s1", 1, 1, ""), (3, "again", "en", "s1", 1, 1, ""), (-50, "", "", "", 0, 0, "")]
    return out


@pytest.mark.parametrize(("fanout", "levels"), [(16, 3), (2, 2), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, fanout, levels):
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows(), fanout), key=repr)


def test_untampered_rows_verify(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert all(r.verified for r in merkle.manifest(docs).collect())


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(9, "Some TEXT", None, None, 9, 0, "")], SCHEMA)
    (r,) = merkle.manifest(one, tampered=F.lit(True)).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == hashlib.sha256(b"").hexdigest() and not r.verified and r.folded_root != r.root
    assert merkle.manifest(one.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4096])
def test_traversal_gives_each_path_with_few_nodes(n):
    leaves = [h(str(i)).encode() for i in range(n)]
    top = merkle.height(n)
    tree = levels_of([x.decode() for x in leaves], 16)
    assert merkle.fold(leaves, top).decode() == tree[-1][0]
    for i, path in enumerate(merkle.traverse(leaves, top)):
        assert [(a.decode(), b.decode()) for a, b in path] == [("".join(a), "".join(b)) for a, b in path_of(tree, i, 16)]
        assert merkle.climb(leaves[i], path).decode() == tree[-1][0]
