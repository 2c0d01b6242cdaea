"""One query for each operator of this package, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quant, hilbert_pack, langid, license_scan, multi_index, ngram_trie, phrase_counts, phrase_index, pii, simhash_ring, token_files, url_trees, warc_index


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = langid.held_out("doc_id", 7, 2)
    scored = ngram_trie.score(_table(spark, sf_dir, "documents"), ~held_out, order=3)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quant.search(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_index.archived(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_licenses"), F.array_join("matches.license", ",").alias("licenses"), F.array_max("matches.coverage").alias("best_coverage"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, table, folder = token_files.write_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50257, end=0)
    return token_files.read_files(manifest, table, folder)


def op8_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_pack.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ring.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(_table(spark, sf_dir, "pages"))


def op12_hat_trie_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_counts.collocations(_table(spark, sf_dir, "documents"))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.mine(_table(spark, sf_dir, "embeddings")).drop("positive_rank")


QUERIES = {f.__name__: f for f in (op1_ngram_trie, op2_additive_quantisation, op3_language_id, op4_pii, op5_capture_index, op6_license_alignment, op7_token_files, op8_phrase_index, op9_hilbert_packing, op10_simhash_pigeonring, op11_url_trees, op12_hat_trie_phrases, op13_multi_index)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op5_capture_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keep FROM q)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN keep <> page_id THEN keep END AS refers_to
        FROM r""",
    "op8_phrase_index": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[s : s + 12], ' ') AS phrase
               FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT size FROM bw),
        dw AS (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS phrase
               FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(s) WHERE len(w) >= size),
        hits AS (SELECT doc_id, item_id, s, dw.size AS size FROM dw JOIN bw ON dw.size = bw.size AND dw.phrase = bw.phrase),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + size)) AS t(p) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_hat_trie_phrases": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
        f AS (SELECT lang, size, phrase, count(*) AS f FROM (
                SELECT lang, size, array_to_string(w[s : s + size - 1], ' ') AS phrase
                FROM p, unnest(range(1, 5)) AS k(size), unnest(range(1, len(w) - size + 2)) AS t(s) WHERE len(w) >= size)
              GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : size], ' ') AS rp FROM c, unnest(range(1, size)) AS t(k)),
        scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
                   FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
        cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, phrase, max(a) AS around FROM (
                     SELECT lang, a, array_to_string(w[s : s + z - 1], ' ') AS phrase FROM c, unnest(range(2, size)) AS t(z), unnest(range(1, size - z + 2)) AS u(s))
                   GROUP BY lang, phrase),
        kept AS (SELECT cut.* FROM cut LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a)
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_multi_index": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
                   FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
              FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        WHERE rank <= 3""",
}
