import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import tiktoken

from terralign.llm import bpe, queries

from .test_near_dedup import brute as near_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns or name == "byte bpe"
        at[name] = docs.collect()
    good, exact, near, mixed, coded = at.values()
    best = {}
    for r in good:
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(best.values())
    groups = near_groups([(r.doc_id, r.text) for r in exact], 5, 80)
    assert sorted(r.doc_id for r in near) == sorted(i for i, (_, c) in groups.items() if i == c)
    tables = duckdb.connect()
    tables.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/2/*.parquet'")
    taken = {i: n for i, n in tables.sql(f"SELECT doc_id, taken / size FROM ({queries.OP3_SQL}) WHERE size > 0 AND taken > 0").fetchall()}
    assert Counter(r.doc_id for r in mixed if (r.text or "").split()) == taken
    text = {r.doc_id: r.text for r in near}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed)
    for r in coded:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert all(i in kept for i, q in labels.items() if q)


def test_run_gives_the_same_rows(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 100 and all(r.n_tokens * 4 == len(r.ids) for r in rows)
