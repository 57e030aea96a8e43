"""The registered queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import centroids, decontamination, embedding_dedup, katz, line_dedup, manifest, mixing, quality_rules, simhash, suffix_dedup, token_counts, url_filters, warc
from lodestone.llm.store import Stored, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base counts, base verdict, posterior probability of "good" and the verdict. Null and empty texts count 0
    and fail; equal texts fare alike; no documents give no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = "f"
    rows = Stored(quality_rules.features(docs, "text", at).withColumn("pattern", quality_rules.vote_pattern(at)).drop("text"), "quality").df
    rows = rows.join(F.broadcast(quality_rules.pattern_posteriors(rows, "pattern")), "pattern")
    return rows.select(
        "doc_id",
        *[F.col(f"f_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        quality_rules.base_failed(at).alias("base_failed"),
        "p_good",
        ((~quality_rules.base_failed(at)) & (F.col("p_good") >= 0.5)).alias("kept"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, its source's, the source's target and the words the mix takes. A null text has no words, null is a
    source of its own, rows with one id draw alike; no documents give no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = mixing.mix(docs)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: bytes, bytes in strings of 200 that also start elsewhere, runs of them, digest of the rest. Null is empty;
    equal texts of 200 bytes or more go whole; no documents give no rows."""
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: bytes, tokens, whether over 512. Null is empty; no documents give no rows."""
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that leaked into it. Null and empty texts leak nothing, nor do such items."""
    return decontamination.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: fingerprint and least document id within reach of 2-bit links. Texts without words have fingerprint zero;
    rows without an id link others, but name nothing; no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    prints = Stored(simhash.with_fingerprint(docs, "text", "fp", 3, ["doc_id"]), "simhash-prints").df
    out = simhash.with_component(prints, "doc_id", "fp", "component_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with planted damage: one row per distinct record of either, with its place and what
    became of it. Nulls make records with empty parts; repeated pages are copies of one record; no pages give no rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rec = warc.record(F.col("page_id"), F.col("url"), F.col("html"))

    def leaves(store: DataFrame) -> DataFrame:
        return store.select("page_id", F.octet_length(rec).cast("long").alias("n_bytes"), warc.leaf_digest(rec).alias("digest"))

    return warc.audit(leaves(pages), leaves(warc.damaged(pages)))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: host, path, rule, verdict, the trees' probability. Null urls have empty parts; without labels of both kinds the
    trees say the same of all; no pages give no rows."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    model = url_filters.UrlModel.fit(url_filters.labelled_urls(pages, labels))
    return url_filters.filter_urls(pages.select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines with a word, lines removed, and which. Null and empty texts have none; of repeated documents the
    first keeps its lines; no documents give no rows."""
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: tokens, known ones, base score and the model's. Null is the end token alone; rows with one id are scored each;
    no documents give no rows."""
    return katz.fit_and_score(table(spark, sf_dir, "documents"))


#: Clusters and rounds of op11.
CLUSTERS, ROUNDS = 40, 5


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector of 64 finite components: cluster, squared distance, inertias, digest of the centroid. Other vectors are left out; a
    null id starts no cluster; no vectors give no rows."""
    return centroids.clusters(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: direct links, least id within reach, whether that is its own. Vectors without a direction link with nothing; equal
    ones link; no vectors give no rows."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: leaf, roots, digest of its proof, and whether the document as it is found later still leads to the root. Null
    values have their own mark, equal rows are leaves of their own; no documents give no rows."""
    return manifest.verified_manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_mixing,
        op3_suffix_array_dedup,
        op4_token_counts,
        op5_decontamination,
        op6_simhash,
        op7_warc_fixity,
        op8_url_filters,
        op9_line_dedup,
        op10_katz_scores,
        op11_centroid_clusters,
        op12_embedding_dedup,
        op13_merkle_manifest,
    )
}
ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE,
    "op7_warc_fixity": warc.ORACLE,
    "op11_centroid_clusters": centroids.oracle(CLUSTERS, ROUNDS),
    "op12_embedding_dedup": embedding_dedup.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
