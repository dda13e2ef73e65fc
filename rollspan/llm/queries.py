"""The queries of the training-data operators and their SQL twins."""

import public_tokenizers
from pyspark.sql import functions as F

from rollspan.llm import (
    collocations,
    hard_negatives,
    near_dups,
    ngram_trie,
    packing,
    pivots,
    pseudonyms,
    quality,
    secret_scan,
    slots,
    templates,
    token_files,
    warc,
)

QUERIES = {}
ORACLES = {}


def _query(name, sql=None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_minhash_near_duplicates")
def op1(spark, sf_dir):
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


@_query("op4_token_files")
def op4(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = token_files.write_tokens(_table(spark, sf_dir, "documents"), path, end_id=2)
    return token_files.read_tokens(spark, folder)


@_query("op6_concatenate_and_cut")
def op6(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path, end_id=1, length=2048)


@_query("op7_virtual_slot_shards")
def op7(spark, sf_dir):
    return slots.shard_documents(_table(spark, sf_dir, "documents"), shards=16)


TOP_K_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS r FROM scores
) WHERE r <= 10
"""


@_query("op8_pivot_top_k", TOP_K_SQL)
def op8(spark, sf_dir):
    return pivots.top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100)


@_query("op10_quality_discriminant")
def op10(spark, sf_dir):
    return quality.classify(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


@_query("op2_template_decontamination")
def op2(spark, sf_dir):
    found = templates.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("key")


@_query("op5_feistel_pseudonyms")
def op5(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark))


WARC_SQL = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS mark FROM pages
), latest AS (
  SELECT mark, max(page_id) AS latest, count(*) AS n FROM rows GROUP BY mark
)
SELECT page_id,
       CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(mark, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT)
           >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN n > 1 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id < latest THEN latest END AS refers_to
FROM rows JOIN latest USING (mark)
"""


@_query("op9_warc_salvage", WARC_SQL)
def op9(spark, sf_dir):
    folder, files = warc.write_archives(_table(spark, sf_dir, "pages"), least_bytes=0)
    return (
        warc.read_archives(spark, folder, files)
        .filter("kind = 'record'")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )


@_query("op3_elias_fano_trie")
def op3(spark, sf_dir):
    return ngram_trie.score_documents(_table(spark, sf_dir, "documents"))


@_query("op11_trigram_secret_scan")
def op11(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan(docs))


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT doc_id, row_number() OVER () AS piece, lang, piece AS body FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), words AS (
  SELECT lang, piece, list_filter(string_split_regex(body, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM words, range(1, 6) AS lengths(m) WHERE len(w) >= m)
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT lang, array_to_string(w[s : s + k - 1], ' ') AS phrase, a FROM (
    SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS s
    FROM candidates, range(2, 5) AS parts(k) WHERE k < m)
), free AS (
  SELECT * FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n,
         CAST((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM free) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.m], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts) WHERE nth = 1
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
) WHERE rank <= 2000
"""


@_query("op12_stripes_collocations", COLLOCATION_SQL)
def op12(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


HARD_NEGATIVE_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS place, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.place, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS nth FROM scores WHERE same
  ) WHERE nth <= 5
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.place, p.nth ORDER BY s.score DESC, s.vec_id) AS r
  FROM positives p JOIN scores s
    ON s.place = p.place AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
) WHERE r <= 3
"""


@_query("op13_strassen_hard_negatives", HARD_NEGATIVE_SQL)
def op13(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), label)
