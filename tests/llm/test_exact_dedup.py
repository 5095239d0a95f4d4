import hashlib
from collections import defaultdict

import numpy as np

from terralign.llm import exact_dedup


def rows():
    out = [(i, f"text {i % 40}", "x") for i in range(300)]
    out += [(1000, None, "x"), (1001, "", "x"), (1002, "long " * 100_000, "x"), (1003, "long " * 100_000, "y"), (5, "text 5", "again"), (None, "text 1", "x"), (None, "alone", "x")]
    return out + [(2000 + i, "hot", "x") for i in range(3000)]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, fp string").repartition(7)
    groups = defaultdict(list)
    for i, t, _ in rows():
        groups[t or ""].append(i)
    got = exact_dedup.resolve(docs).collect()
    assert len(got) == len(rows())
    want = sorted(((repr(i), max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows()), key=repr)
    assert sorted(((repr(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    kept = left.collect()
    assert len(kept) == len(groups) and {r.text or "" for r in kept} == set(groups)
    assert all(r.doc_id == max((x for x in groups[r.text or ""] if x is not None), default=None) for r in kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.resolve(docs).count() == 0 and exact_dedup.deduplicate(docs).count() == 0


def test_rice_round_trip():
    rng = np.random.default_rng(3)
    for bits, n, shift in ((20, 500, 10), (48, 3000, 36), (16, 1, 3), (16, 40, 0)):
        low = 1 << (bits - 1)
        values = np.unique(rng.integers(low, low + (1 << min(bits - 1, shift + 10)), n, dtype=np.uint64))
        assert np.array_equal(exact_dedup.rice_decode(exact_dedup.rice_encode(values, low, shift)), values)
    layout = exact_dedup.Layout(10_000_000)
    assert layout.cuts()[-1] == 1 << layout.bits and len(layout.cuts()) == layout.owners + 1


def test_of_rows_alike_in_id_and_text_the_same_one_stays(spark):
    rows = [(i, "same", c, {"k": c}) for i in (1, None) for c in "abcdef"] + [(7, t, c, {}) for t in (None, "") for c in "xy"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, more map<string, string>")
    kept = [sorted(map(str, exact_dedup.deduplicate(docs.repartition(n)).collect())) for n in (1, 2, 3, 5)]
    assert len(kept[0]) == 2 and all(k == kept[0] for k in kept)
