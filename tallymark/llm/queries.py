"""The operators over the given tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import shared_folder, table
from .embedding_dedup import near_vectors
from .hard_negatives import hard_negatives
from .licenses import scan_licenses
from .line_dedup import drop_shared_lines
from .mixing import plan_mixture
from .packing import pack
from .quality import score_quality
from .sharding import shard_documents
from .simhash_dedup import simhash_classes
from .toxicity import score_toxicity
from .warc import read_warc, record_key, write_warc
from .whitening import whiten


def tokenizer_path() -> str:
    """Where the public tokenizer of the packing query lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per document before and after, and what is left of its text as a digest."""
    done = drop_shared_lines(table(spark, sf_dir, "documents"), max_docs=1, min_chars=10)
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 24 shards of nearly equal bytes."""
    dealt = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return dealt.select(
        "row.doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of a mixture of all sources in which none is passed more than twice."""
    mixture = plan_mixture(table(spark, sf_dir, "documents"), max_repeats=2.0)
    drawn = mixture.draws(mixture.sizes, F.col("id"), F.col("source"))
    return drawn.select(
        F.col("row.id").alias("doc_id"),
        "row.source",
        "row.tokens",
        F.round("weight", 9).alias("weight"),
        "block",
        F.round("place", 9).alias("place"),
    )


def op4_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other rows of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, in order, and how many known sentences they hold."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id",
        F.size("identifiers").cast("long").alias("n_known"),
        F.array_join("identifiers", " ").alias("identifiers"),
        F.array_join("licenses", " ").alias("licenses"),
        F.size("unmatched").cast("long").alias("n_unmatched"),
    )


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, between equal labels at cosine 0.93 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93).select("row.vec_id", "n_links", "component_id", "kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens, ids as a checksum."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), length=4096, checksum=True)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of 3-word shingles and component within 3 bits of every document."""
    return simhash_classes(table(spark, sf_dir, "documents"), words=3, reach=3)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels that are not held out."""
    judged = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels that are not held out."""
    judged = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return judged.select("row.doc_id", "held_out", "score", predicted)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight principal components, scaled to unit variance."""
    white = whiten(table(spark, sf_dir, "embeddings"), components=8)
    rows = white.select(
        F.col("id").alias("vec_id"), "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", "explained",
        F.posexplode("whitened").alias("at", "whitened"),
    )
    component = (F.col("at") + 1).alias("component")
    return rows.select("vec_id", component, "n", "deviation", "whitened", F.get("explained", "at").alias("explained"), "identity_error")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has the next label."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, and what the archives hold."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder)
    records = read_warc(spark, folder)
    revisit = F.col("record_type") == "revisit"
    return records.select(
        record_key(F.col("record_id")).cast("long").alias("page_id"),
        F.when(revisit, F.col("said")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("declared", ":", -1)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, record_key(F.col("refers_to")).cast("long")).alias("refers_to"),
    )


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_approximate_nearest_neighbours": op4_approximate_nearest_neighbours,
    "op5_license_scan": op5_license_scan,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_packing": op7_packing,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_toxicity": op10_toxicity,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc": op13_warc,
}

ORACLE = {
    "op1_line_dedup": """
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
            SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
        ), keyed AS (
            SELECT *, translate(
                trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), shared AS (
            SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), judged AS (
            SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > s.first, false) AS gone
            FROM keyed k LEFT JOIN shared s ON k.key = s.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op3_mixing": """
        WITH RECURSIVE sizes AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens
            FROM documents
        ), totals AS (
            SELECT source, sum(tokens)::BIGINT AS tokens FROM sizes GROUP BY source
        ), shares AS (
            SELECT source, tokens, tokens / (SELECT sum(tokens)::DOUBLE FROM totals) AS share FROM totals
        ), ends AS (
            SELECT min(share) AS least, max(share) AS most FROM shares
        ), halved AS (
            SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
            UNION ALL
            SELECT step + 1,
                   CASE WHEN pow(least / most, (low + high) / 2 - 1) <= 2 THEN low ELSE (low + high) / 2 END,
                   CASE WHEN pow(least / most, (low + high) / 2 - 1) <= 2 THEN (low + high) / 2 ELSE high END
            FROM halved, ends WHERE step < 40
        ), exponent AS (
            SELECT CASE WHEN pow(least / most, -1) <= 2 THEN 0.0 ELSE high END AS a
            FROM halved, ends WHERE step = 40
        ), amounts AS (
            SELECT source, tokens, pow(share, a) / sum(pow(share, a)) OVER () AS weight,
                   pow(share / most, a - 1) AS passes,
                   floor(pow(share / most, a - 1) * tokens + 0.5)::BIGINT AS budget
            FROM shares, ends, exponent
        ), keyed AS (
            SELECT s.*, weight, passes, budget, budget // a.tokens AS whole,
                   budget - (budget // a.tokens) * a.tokens AS remaining,
                   ('0x' || substr(md5(s.doc_id || chr(31) || (budget // a.tokens) || chr(31) || '42'), 1, 15))::BIGINT AS key
            FROM sizes s JOIN amounts a ON s.source = a.source
        ), counted AS (
            SELECT *, whole + (sum(tokens) OVER (PARTITION BY source ORDER BY key) <= remaining)::INT AS times FROM keyed
        ), drawn AS (
            SELECT *, unnest(range(times)) AS block FROM counted
        )
        SELECT doc_id, source, tokens, round(weight, 9) AS weight, block::INT AS block,
               round(least(1, (block + ('0x' || substr(md5(doc_id || chr(31) || block || chr(31) || '42'), 1, 15))::BIGINT
                               / 1152921504606846976.0) / passes), 9) AS place
        FROM drawn""",
    "op12_hard_negatives": """
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND NOT list_contains(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)), true)
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
                   list_inner_product(a.x, c.x)::BIGINT AS score
            FROM vectors a JOIN vectors c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), ranked AS (
            SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS place
            FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id
            WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        )
        SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE place <= 5""",
    "op13_warc": """
        WITH bodies AS (
            SELECT page_id, coalesce(html, '') AS body FROM pages
        ), named AS (
            SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
                   min(page_id) OVER (PARTITION BY body) AS first
            FROM bodies
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
                   ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM named""",
}
