"""The queries of the pipeline operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgwarden.llm import (
    count_rtree,
    crf_secrets,
    hard_negatives,
    host_reputation,
    html_blocks,
    kmeans_tree,
    lz_fingerprint,
    mixing,
    simhash,
    toxicity,
    whitening,
    window_dedup,
)
from pkgwarden.llm.bpe_tree import BpeTree

#: Fixed rules of the contract, by host and path.
URL_RULES = [
    host_reputation.Rule("net", "/", "block"),
    host_reputation.Rule("example.net", "/en/", "allow"),
    host_reputation.Rule("example.com", "/de/", "block"),
    host_reputation.Rule("org", "/fr/", "allow"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lz_fingerprint.edit_tails(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract_main_text(pages).select(
        "page_id",
        "url",
        F.col("main_text").alias("text"),
        F.length("main_text").cast("long").alias("n_chars"),
    )


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op3_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf_secrets.train(docs)
    found = docs.select("doc_id", crf_secrets.find_secrets(docs, model).alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        _count(F.col("found"), "assign").alias("n_assign"),
        _count(F.col("found"), "access").alias("n_access"),
        _count(F.col("found"), "hex").alias("n_hex"),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )


#: Every so many ids are queries; neighbours returned.
QUERY_STEP = 20
NEIGHBOURS = 20


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = kmeans_tree.build_index(vectors, NEIGHBOURS)
    asked = vectors.filter(F.pmod("vec_id", F.lit(QUERY_STEP)) == 0)
    return kmeans_tree.search(index, asked.select(F.col("vec_id").alias("id")), NEIGHBOURS)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.hex("mark")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def bpe_tree(spark: SparkSession) -> BpeTree:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return BpeTree(spark, path, public_tokenizers.PATTERN)


def digest_of_ids(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_tree(spark).round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest_of_ids(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of an id are taken as the outcome of the page of that id."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    endings = F.array(*[F.lit(s) for s in host_reputation.LONG_SUFFIXES])
    suffixes = spark.range(1).select(F.explode(endings).alias("suffix"))
    judged = host_reputation.filter_urls(
        table(spark, sf_dir, "pages"), outcomes, URL_RULES, suffixes=suffixes
    )
    return judged.select("page_id", "host", "path", "rule", "verdict")


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are null belong to the held-out fold, as the empty text would."""
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id")) != 0)
    model = toxicity.train(docs, learned, "toxic")
    scored = docs.select("doc_id", toxicity.score(docs, model).alias("score"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


#: Ids divisible by this are anchors; ids divisible by the other get the next of ten labels.
ANCHOR_STEP = 100
NOISY_STEP, LABELS = 7, 10


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.col("vec_id") % NOISY_STEP == 0
    label = F.when(noisy, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    named = vectors.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(named, F.col("id") % ANCHOR_STEP == 0)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_rtree.similarity_join(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("component", "component_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lz_fingerprint": op1_lz_fingerprint,
        "op2_html_blocks": op2_html_blocks,
        "op3_crf_secrets": op3_crf_secrets,
        "op4_kmeans_tree": op4_kmeans_tree,
        "op5_simhash": op5_simhash,
        "op6_bpe_tree": op6_bpe_tree,
        "op7_host_reputation": op7_host_reputation,
        "op8_toxicity": op8_toxicity,
        "op9_window_dedup": op9_window_dedup,
        "op10_mixing": op10_mixing,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_ngram_join": op12_ngram_join,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_host_reputation": SQL_HOST_REPUTATION,
        "op9_window_dedup": SQL_WINDOW_DEDUP,
        "op11_hard_negatives": SQL_HARD_NEGATIVES,
        "op12_ngram_join": SQL_NGRAM_JOIN,
    }


_ENDINGS = ", ".join(f"'{suffix}'" for suffix in host_reputation.LONG_SUFFIXES)

SQL_HOST_REPUTATION = f"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), hosts AS (
  SELECT host, count(bad) AS n, count(*) FILTER (bad) AS bad,
    CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_ENDINGS})
      THEN array_to_string(string_split(host, '.')[-3:], '.')
      ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
    CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_ENDINGS})
      THEN array_to_string(string_split(host, '.')[-2:], '.')
      ELSE string_split(host, '.')[-1] END AS suffix
  FROM parts LEFT JOIN (SELECT doc_id, quality = 0 OR toxic = 1 AS bad FROM labels) l
    ON page_id = doc_id AND bad IS NOT NULL
  GROUP BY host
), overall AS (
  SELECT (sum(bad) + 1)::DOUBLE / (sum(n) + 2) AS prior FROM hosts
), suffix_counts AS (
  SELECT suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(prior) AS prior
  FROM hosts, overall GROUP BY suffix
), suffix_sums AS (
  SELECT sum(n * (bad / n - prior) ** 2) AS spread, sum(prior * (1 - prior)) AS noise,
    sum(n * prior * (1 - prior)) AS scale FROM suffix_counts WHERE n > 0
), suffix_strength AS (
  SELECT CASE WHEN scale IS NULL OR scale <= noise OR spread <= noise THEN 1000.0
    ELSE least(1000.0, greatest(1.0, (scale - noise) / (spread - noise) - 1)) END AS s
  FROM suffix_sums
), suffixes AS (
  SELECT suffix, (prior * s + bad) / (s + n) AS prior FROM suffix_counts, suffix_strength
), domain_counts AS (
  SELECT domain, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(prior) AS prior
  FROM hosts JOIN suffixes USING (suffix) GROUP BY domain
), domain_sums AS (
  SELECT sum(n * (bad / n - prior) ** 2) AS spread, sum(prior * (1 - prior)) AS noise,
    sum(n * prior * (1 - prior)) AS scale FROM domain_counts WHERE n > 0
), domain_strength AS (
  SELECT CASE WHEN scale IS NULL OR scale <= noise OR spread <= noise THEN 1000.0
    ELSE least(1000.0, greatest(1.0, (scale - noise) / (spread - noise) - 1)) END AS s
  FROM domain_sums
), domains AS (
  SELECT domain, (prior * s + bad) / (s + n) AS prior FROM domain_counts, domain_strength
), host_counts AS (
  SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad, prior FROM hosts JOIN domains USING (domain)
), host_sums AS (
  SELECT sum(n * (bad / n - prior) ** 2) AS spread, sum(prior * (1 - prior)) AS noise,
    sum(n * prior * (1 - prior)) AS scale FROM host_counts WHERE n > 0
), host_strength AS (
  SELECT CASE WHEN scale IS NULL OR scale <= noise OR spread <= noise THEN 1000.0
    ELSE least(1000.0, greatest(1.0, (scale - noise) / (spread - noise) - 1)) END AS s
  FROM host_sums
), judged AS (
  SELECT host, prior * s + bad AS a, (1 - prior) * s + n - bad AS b FROM host_counts, host_strength
), bounds AS (
  SELECT host, a / (a + b) AS share,
    a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM judged
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts JOIN bounds USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL OR bound <= 0.5 THEN 'allow' ELSE 'block' END AS verdict
FROM ruled
"""

SQL_WINDOW_DEDUP = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS run
  FROM split, unnest(range(1, len(words) - 18)) AS n(i)
), repeated AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1
), covered AS (
  SELECT DISTINCT doc_id, j FROM repeated, unnest(range(i, i + 20)) AS n(j)
), kept AS (
  SELECT s.doc_id, string_agg(words[j], ' ' ORDER BY j) AS kept, count(*) AS n
  FROM split s, unnest(range(1, len(words) + 1)) AS n(j)
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = s.doc_id AND c.j = n.j)
  GROUP BY s.doc_id
)
SELECT s.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept USING (doc_id)
"""

SQL_HARD_NEGATIVES = """
WITH usable AS (
  SELECT vec_id AS id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pairs AS (
  SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same,
    list_inner_product(a.x, b.x)::BIGINT AS score
  FROM usable a JOIN usable b ON a.id % 100 = 0 AND b.id <> a.id
), positives AS (
  SELECT anchor, id AS positive, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
), negatives AS (
  SELECT p.anchor, p.positive, p.score AS positive_score, n.id AS negative, n.score,
    row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.id) AS place
  FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor AS anchor_id, positive AS positive_id, place::INTEGER AS rank,
  negative AS negative_id, positive_score, score AS negative_score
FROM negatives WHERE place <= 10
"""

SQL_NGRAM_JOIN = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2),
      lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams
  FROM split
), grams AS (
  SELECT doc_id, unnest(grams) AS gram FROM sets
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * common >= 85 * (len(a.grams) + len(b.grams) - common)
), ends AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT y, other FROM reached JOIN ends ON x = doc_id
)
SELECT s.doc_id, len(any_value(grams))::BIGINT AS n_shingles, min(other) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""
