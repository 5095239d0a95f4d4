import math
from collections import Counter, defaultdict

from terralign.llm import mixing


def rows():
    out = [(i, "w " * (i % 37 + 1), f"s{i % 5}") for i in range(500)] + [(1000 + i, "x y z", "big") for i in range(3000)]
    return out + [(9000, None, "s0"), (9001, "", None), (9002, "a b\tc\nd  ", None), (9003, "long " * 50_000, "s1"), (None, "no id", "s2"), (3, "w w", "s3"), (3, "w w", "s3"), (9004, None, "empty")]


def filled(sizes, share=1.5, most=2):
    """Targets by resharing what is above a cap until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, budget, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = budget / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not above:
            target |= {s: level * weight[s] for s in free}
            break
        for s in above:
            target[s] = most * sizes[s]
            budget -= target[s]
        free -= above
    return target


def test_targets_and_words_taken(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in rows()], "doc_id long, text string, source string, size string")
    got = mixing.mix(mixing.word_counts(docs)).collect()
    assert len(got) == len(rows())
    sizes = defaultdict(int)
    for _, t, s in rows():
        sizes[s] += len((t or "").split())
    want, taken, largest = filled(dict(sizes)), Counter(), Counter()
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mixing.mix(mixing.word_counts(docs), partitions=3).collect()
    key = lambda r: (r.source or "", r["size"], r.doc_id or -1, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_documents_are_repeated(spark):
    docs = spark.createDataFrame([r for r in rows() if r[0] not in (None, 3)], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(mixing.word_counts(docs)).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(mixing.word_counts(docs)).count() == 0 and mixing.mixed_documents(docs).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(i, f"word {'x ' * (i % 5)}", "a", 777, 1, 2, 3) for i in range(40)] + [(5, "word ", "a", 777, 1, 2, 3)] * 7 + [(5, "word ", "a", 778, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __n long, __i long, __row_key long, copies long")
    one, two = (sorted(map(tuple, mixing.mixed_documents(docs.repartition(n)).collect())) for n in (1, 5))
    assert one == two and set(one) <= set(rows)
    taken = mixing.mix(mixing.word_counts(docs)).agg({"copies": "sum"}).first()[0]
    assert len(one) == taken
