"""The registered queries of the training-data operators; thin wrappers that derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokensieve.llm import bpe_automaton, chaining, dac, jaccard_join, mixing, near_vectors, sharding, simhash, toxicity, warc
from tokensieve.llm.common import join_hot_inner, materialize, rows_in, words_of


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, read back as chunks; the last chunk of a record carries its whole length and digest."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_warc(warc.plan_records(pages))
    last = warc.read_chunks(spark, manifest, data=False).where("is_last")
    response = F.col("record_type") == "response"
    return last.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenized, written as directly addressable codes and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dac.read_tokens(dac.write_tokens(docs), keep_ids=False)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the merge automaton."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_automaton.encode_documents(docs, keep_ids=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, how near they are to each other and to the next document's, and how many others are within the radius."""
    docs = simhash.with_neighbour(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = docs.select("_range", "_row", "_ghost", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    key = ["_range", "_row", "_ghost", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = rows.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t")))).alias("x"))
    prints = simhash.fingerprints(both.select(*key, "x.e", "x.t"), [*key, "e"], "t")
    pick = [F.max(F.when(F.col("e") == e, F.col(c))).alias(f"{p}{c}") for e, p in ((0, ""), (1, "e")) for c in ("hi", "lo")]
    prints = prints.groupBy(*key).agg(*pick)
    w = Window.partitionBy("_range").orderBy("_row")
    prints = prints.withColumn("nhi", F.lag("hi").over(w)).withColumn("nlo", F.lag("lo").over(w)).where("_ghost = 0")
    like = lambda p: simhash.likeness(*[F.col(c) for c in ("hi", "lo", f"{p}hi", f"{p}lo")])
    prints = prints.select(
        "doc_id", "n_chars", "edited_sha256", simhash.shown("hi", "lo").alias("fingerprint"), simhash.shown("ehi", "elo").alias("edited_fingerprint"),
        like("e").alias("near_edited"), like("n").alias("near_next"), "hi", "lo",
    )
    prints = materialize(prints, "fingerprints")
    near = materialize(simhash.near_counts(prints), "fingerprints-near")
    return join_hot_inner(prints, near, ["hi", "lo"], "copies", rows_in(prints)).drop("hi", "lo", "copies")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model that was fitted outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, learn=~toxicity.held_out())
    scored = toxicity.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of 50 words or more that an earlier document holds too, edited or not."""
    found = chaining.passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "source_doc_id", F.col("source_start").alias("source_start_word"), F.col("source_end").alias("source_end_word"), F.col("equal").alias("equal_words"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at a Jaccard similarity of 0.8 or more over five-word shingles."""
    out = jaccard_join.jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors linked at a cosine of 0.95 or more."""
    return near_vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the contract's targets; the sizes are counted once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_of(F.col("text")).alias("size")), "sizes")
    mixed = mixing.mix(sized, size="size")
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken"), "source", F.col("mix_copies").alias("copies"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents brought in as small shards, compacted, and read back from the committed manifest."""
    store = sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    store.vacuum()
    rows = store.read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("length"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_token_binary": op2_token_binary,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_passages": op6_passages,
    "op7_jaccard": op7_jaccard,
    "op8_embeddings": op8_embeddings,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM q WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT q.page_id, q.payload_bytes::BIGINT AS payload_bytes, q.payload_digest,
  CASE WHEN k.keeper IS NOT NULL AND k.keeper <> q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper <> q.page_id THEN k.keeper END AS refers_to
FROM q LEFT JOIN k ON q.payload_digest = k.payload_digest AND q.payload_bytes >= 1000""",
    "op10_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256, length(text)::BIGINT AS length FROM documents",
}
