import random

from pyspark.sql import functions as F

from terralign.llm import langid

WORDS = {"en": "the and with from that this have thing other under", "de": "und der nicht eine schön über straße auch wenn mit", "fr": "les des été une avec où être pour dans qui"}


def rows(n=240, seed=4):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[lang].split()) for _ in range(rnd.randrange(5, 60))), lang) for i in range(n) for lang in [rnd.choice(list(WORDS))]]


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!", "fr"), (1003, "the other thing " * 20_000, None), (None, "und der nicht", "de"), (1, rows()[1][1], "xx")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows() + odd], "doc_id long, text string, lang string, score string")
    got = langid.identify(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 4 != 2).collect()
    assert len(got) == len(rows()) + len(odd)
    by = {r.doc_id: r for r in got if r.doc_id != 1}
    held = [(i, lang) for i, _, lang in rows() if i % 4 == 2]
    assert sum(by[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en" and by[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)


def test_far_text_is_rejected(spark):
    docs = spark.createDataFrame(rows() + [(9999, "Ωμέγα ψυχή ξένος " * 9, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.rejected for r in langid.identify(docs, F.lit(True)).collect()}[9999]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs, F.lit(True)).collect()] == ["und"]
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    from terralign.llm import queries

    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.op1_language_id(spark, sf).collect() if r.held_out and truth[r.doc_id]]
    assert len(rows) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_the_sample_is_bounded_for_any_ids(spark, monkeypatch):
    """Null ids, one id for all, and copies of one row: none of them comes whole into the fit."""
    monkeypatch.setattr(langid, "SAMPLE", 50)
    texts = [(None, f"the other {i}", "en") for i in range(2000)] + [(7, f"under that {i}", "de") for i in range(2000)] + [(9, "les des", "fr")] * 2000
    docs = spark.createDataFrame(texts, "order long, lang string, text string".replace("lang string, text", "text string, lang")).repartition(5)
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    n = {r.lang: r["count"] for r in langid.sampled(docs, sizes).groupBy("lang").count().collect()}
    assert 20 <= n["en"] <= 100 and 20 <= n["de"] <= 100 and n.get("fr", 0) <= 1
