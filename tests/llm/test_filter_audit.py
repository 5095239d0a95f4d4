import itertools
import re
from collections import defaultdict

import numpy as np

from terralign.llm import filter_audit

WORDS = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    None, "", WORDS, WORDS + " $", "one two", "A" * 50 + " b", "same " * 150, WORDS.upper(), "é" * 9 + "A", "é" * 8 + "AB", "wide word " * 100, WORDS, "\x1f\x85" + WORDS, "C|" * 3, "long " * 40_000 + "#",
]


def brute(rows, labels):
    """The contract's counts, row by row and order by order."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marked = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
        says = [i is not None and any(x == i and v[k] == 1 for x, *v in labels) for k in (0, 1)]
        marked.append((part or "", {f for f, b in zip("ABCDE", bad, strict=True) if b}, *says))
    out, shapley = {}, defaultdict(int)
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                fails = sum(f in m[1] for m in own)
                out[part, order, step] = (len(left), len(gone), fails - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def fixture():
    rng = np.random.default_rng(5)
    rows = [(i, TEXTS[int(k)], ["en", "de", None, ""][int(p)]) for i, (k, p) in enumerate(zip(rng.integers(0, len(TEXTS), 400), rng.integers(0, 4, 400), strict=True))]
    rows += [(7, rows[7][1], rows[7][2]), (7, "other", "en"), (None, TEXTS[2], "en"), (None, None, None), (-3, TEXTS[2], "fr"), (-3, TEXTS[2], "fr")]
    labels = [(int(i), *(None if x == 2 else int(x) for x in q)) for i, q in zip(rng.integers(-5, 420, 300), rng.integers(0, 3, (300, 2)), strict=True)] + [(None, 1, 1)]
    return rows, labels


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    rows, labels = fixture()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, fails int").repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(got) == len(found) and found == brute(rows, labels)


def test_many_parts_and_more_rows_than_a_word(spark):
    rows = spark.range(3000).selectExpr("cast(id % 997 AS string) AS part", "cast(pmod(hash(id), 8) AS int) AS fails", "id % 3 = 0 AS good", "id % 7 = 0 AS toxic")
    got = {(r.part, r.subset): (r.kept, r.good, r.toxic) for r in filter_audit.subset_counts(rows, 3).collect()}
    want = defaultdict(lambda: np.zeros(3, int))
    for r in rows.collect():
        for subset in range(8):
            want[r.part, subset] += np.array([1, r.good, r.toxic]) * (r.fails & subset == 0)
    assert got == {k: tuple(v) for k, v in want.items()}


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in one)
