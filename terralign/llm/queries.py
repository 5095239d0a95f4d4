"""The queries of the text operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, filter_audit, langid, merkle, mixing, near_dedup, passages, quality, quotes, search, secrets


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; one that is read in fewer partitions than there are cores is dealt out first, as work on texts is long."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    found = langid.identify(_documents(spark, sf_dir), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = secrets.findings(docs, secrets.update(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.word_counts(_documents(spark, sf_dir))
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "lang", F.col("n").alias("n_characters"), "perplexity", "least", "limit", "accepted")


def op6_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 asks for its ten best among all documents."""
    return search.top_k(_documents(spark, sf_dir), F.col("doc_id") % 20 == 0, k=10)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.resolve(_documents(spark, sf_dir), words=4, percent=80)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(_documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode_texts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir), tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, 'assign' AS name, 0 AS rank, 12 AS least, string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS p,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g FROM d
  UNION ALL
  SELECT doc_id, 'access', 1, 18, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) FROM d
  UNION ALL
  SELECT doc_id, 'hex', 2, 16, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0) FROM d),
parts AS (SELECT doc_id, name, rank, least, i,
    sum(len(p[i])) OVER w + coalesce(sum(len(m[i])) OVER (PARTITION BY doc_id, name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    len(m[i]) AS size, len(g[i]) AS measured
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)
  WINDOW w AS (PARTITION BY doc_id, name ORDER BY i ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT doc_id, count(*) FILTER (name = 'assign') AS a, count(*) FILTER (name = 'access') AS b, count(*) FILTER (name = 'hex') AS c,
    string_agg(name || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) AS s
  FROM parts WHERE measured >= least GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, len([x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight,
    (coalesce(sum(source_size) OVER o, 0) * 2)::BIGINT AS used, (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS open
  FROM w WINDOW o AS (ORDER BY source_size * (6 // weight), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (all_size * 3 - used * 2) * weight >= source_size * 4 * open AS capped FROM f),
l AS (SELECT *, (all_size * 3 - coalesce(sum(source_size * 2) FILTER (capped) OVER (), 0)::BIGINT * 2)::DOUBLE / 2
      / greatest(coalesce(sum(weight) FILTER (NOT capped) OVER (), 0)::BIGINT, 1) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN (source_size * 2)::DOUBLE ELSE level * weight END AS target,
    ('0x' || substr(md5('7:' || coalesce(source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM l),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, least((floor(rate * (k + 1) + u) - floor(rate * k + u))::BIGINT, 2) * size AS taken FROM k
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, len(w) AS size FROM d),
s AS (SELECT count(*)::DOUBLE AS rows, sum(size)::DOUBLE / count(*) AS mean FROM l),
t AS (SELECT doc_id, g, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(w) AS g FROM d) GROUP BY 1, 2),
f AS (SELECT g, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT t.doc_id AS query_id, g, t.n * ln(1 + (s.rows - df + 0.5) / (df + 0.5)) AS w FROM t JOIN f USING (g), s WHERE t.doc_id % 20 = 0 AND df > 1),
c AS (SELECT query_id, t.doc_id, round(sum(w * (t.n * 2.2 / (t.n + 1.2 * (0.25 + 0.75 * size / mean)))), 6) AS score
  FROM q JOIN t ON t.g = q.g AND t.doc_id <> q.query_id JOIN l ON l.doc_id = t.doc_id, s GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0 QUALIFY rank <= 10
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9_SQL = r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
p AS (SELECT r, k, m, array_to_string(w[k:k + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m)),
h AS (SELECT r, k, m, item_id FROM p JOIN g USING (m, g)),
n AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(k, k + m)) AS x FROM h) GROUP BY 1),
t AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN t ON t.r = d.r
"""

OP12_SQL = r"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce('=' || source, '-') AS g,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0 AS tampered
  FROM documents, c),
e AS (SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lower, tampered FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM e),
u AS (SELECT g, 0 AS lv, idx, n, leaf AS node FROM l UNION ALL
  SELECT g, lv + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY g, lv, idx // 16, n),
s AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM u WHERE n = 1),
v AS (SELECT '' AS g, 100 AS lv, idx, n, node FROM s UNION ALL
  SELECT g, lv + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM v WHERE n > 1 GROUP BY g, lv, idx // 16, n),
q AS (SELECT g, lv, idx, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (FROM u UNION ALL FROM v) WHERE n > 1 WINDOW w AS (PARTITION BY g, lv, idx // 16 ORDER BY idx)),
p AS (SELECT l.g, l.idx, list(before || '|' || after ORDER BY lv) AS path
  FROM l JOIN s ON s.g = l.g JOIN q ON q.g = l.g AND q.idx = l.idx // (16 ** lv)::BIGINT OR q.g = '' AND q.idx = s.idx // (16 ** (lv - 100))::BIGINT GROUP BY 1, 2),
f AS (SELECT l.doc_id, l.leaf, s.node AS subroot, (SELECT node FROM v WHERE n = 1) AS root, coalesce(path, []) AS path, CASE WHEN tampered THEN lower ELSE leaf END AS start
  FROM l JOIN s ON s.g = l.g LEFT JOIN p ON p.g = l.g AND p.idx = l.idx),
r AS (SELECT *, list_reduce([start] || path, lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM r
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * len(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
r AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, 1 << (strpos('ABCDE', o[step]) - 1) AS bit, coalesce(list_sum([1 << (strpos('ABCDE', o[i]) - 1) FOR i IN range(1, step)]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
c AS (SELECT part, o, step, bit, coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0 AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0 AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM r, s GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM c
"""


def queries() -> dict:
    return {"op1_language_id": op1_language_id, "op2_secret_scan": op2_secret_scan, "op3_source_mix": op3_source_mix, "op4_quote_links": op4_quote_links, "op5_quality": op5_quality, "op6_top_k_search": op6_top_k_search, "op7_near_dedup": op7_near_dedup, "op8_repeated_passages": op8_repeated_passages, "op9_exact_dedup": op9_exact_dedup, "op10_byte_bpe": op10_byte_bpe, "op11_decontaminate": op11_decontaminate, "op12_merkle_manifest": op12_merkle_manifest, "op13_filter_audit": op13_filter_audit}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": OP2_SQL, "op3_source_mix": OP3_SQL, "op6_top_k_search": OP6_SQL, "op7_near_dedup": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_decontaminate": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_filter_audit": OP13_SQL}
