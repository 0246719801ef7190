"""The registered queries of the corpus operators and their SQL; a query loads its operator when it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import sharding

    return sharding.shard_rows(_read(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import jaccard_join

    return jaccard_join.ngram_jaccard_join(_read(spark, sf_dir, "documents")).drop("class_key")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import sentencepiece_codec

    return sentencepiece_codec.encode(_read(spark, sf_dir, "documents"), ids=False)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import warc

    return warc.warc_round_trip(_read(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import substring_dedup

    return substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import decontaminate

    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import exact_dedup

    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import language

    docs = _read(spark, sf_dir, "documents")
    return language.identify_language(docs, language.fit(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import toxicity

    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import url_filter

    return url_filter.filter_urls(_read(spark, sf_dir, "pages"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import quality

    docs = _read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import token_alignment

    return token_alignment.align(_read(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import conversation_trie

    return conversation_trie.prefix_trie(_read(spark, sf_dir, "conversations")).drop("x1", "x2")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sharding, op2_jaccard_join, op3_sentencepiece, op4_warc, op5_substring_dedup, op6_decontaminate, op7_exact_dedup, op8_language, op9_toxicity, op10_url_filter, op11_quality, op12_token_alignment, op13_conversation_trie, pipeline]
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(%s, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS % _LOWER} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE
        list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT doc_id, min(o) AS c FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(s, CAST(10 * (i // 8) + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31)), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""

OP5_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS % "coalesce(text, '')"} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(len(w) - 34)) AS i, w FROM w WHERE len(w) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM x),
r AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, i + unnest(range(35)) AS i FROM r),
t AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM w),
o AS (SELECT t.doc_id, count(*) AS n_left, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(o.n_left, 0) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM w LEFT JOIN o ON o.doc_id = w.doc_id
"""

OP7_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS p, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY p DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r
"""

OP10_SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS a FROM pages),
h AS (SELECT page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(a, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r(v, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT h.page_id, v, rh || rp AS rule, row_number() OVER (PARTITION BY h.page_id ORDER BY length(rh || rp) DESC) AS k
  FROM h JOIN r ON (h.host = rh OR h.host LIKE '%.' || rh) AND starts_with(h.path, rp))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.k = 1
"""

OP13_SQL = """
WITH c AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, ''))::VARCHAR || ' ' || coalesce(role, '') || coalesce(text, ''))) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, l, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)),
        lambda p, q: xor(p >> 1, CASE WHEN p & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h FROM c),
b AS (SELECT h.conv_id, coalesce(o.l, [])[1 : h.h] || h.l[h.h + 1 :] AS l FROM h LEFT JOIN h o ON o.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM b),
k AS (SELECT conv_id, d, len(l) = d AS ends, md5(l[1 : d]::VARCHAR) AS x, CASE WHEN d > 0 THEN md5(l[1 : d - 1]::VARCHAR) END AS up, CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END AS n FROM p),
n AS (SELECT d, x, min(conv_id) AS conv_id, count(*) AS n_convs, max(up) AS up, max(n) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids FROM k GROUP BY d, x),
q AS (SELECT n.*, m.conv_id AS parent_conv_id, coalesce(j.c, 0) AS n_children FROM n LEFT JOIN n m ON m.d = n.d - 1 AND m.x = n.up
  LEFT JOIN (SELECT d, up, count(*) AS c FROM n GROUP BY d, up) j ON j.d = n.d + 1 AND j.up = n.x),
s AS (SELECT k.d, k.x, sum((q.n_children = 0)::INT)::BIGINT AS n_leaves, sum((q.n_convs - 1) * q.n)::BIGINT AS saved FROM q JOIN k ON k.conv_id = q.conv_id AND k.d <= q.d GROUP BY k.d, k.x)
SELECT q.conv_id, q.d AS depth, q.parent_conv_id, q.n_convs, q.n_children, s.n_leaves, s.saved AS saved_tokens, sha256(coalesce(q.ids, '')) AS ends_sha256
FROM q JOIN s ON s.d = q.d AND s.x = q.x
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op4_warc": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op10_url_filter": OP10_SQL, "op13_conversation_trie": OP13_SQL}
