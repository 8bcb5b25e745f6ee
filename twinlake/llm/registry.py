"""The registered queries of the numbered operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, media, mixing, pii, prefix_trie, quality, sharding, toxicity, training_order, vector_codes
from .common import Scratch, documents
from .near_dup import near_duplicates
from .packing import pack
from .token_counts import prefix_token_table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are similar by 0.85 or more."""
    return near_duplicates(documents(spark, sf_dir), words=5, percent=85)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as lossless WebP and read back: digests of payload and medium, and features of the samples."""
    stored = media.load(media.store(documents(spark, sf_dir), unit=576))
    samples, medium = F.col("samples"), F.aggregate("media", F.lit(b""), lambda a, b: F.concat(a, b))  # one file up to 9.4 MB of text
    return stored.select(
        "doc_id", "n_bytes", F.octet_length(samples).cast("long").alias("payload_bytes"), F.sha2(samples, 256).alias("payload_sha256"), F.crc32(F.substring(samples, -32, 32)).alias("tail_crc32"),
        F.octet_length(medium).cast("long").alias("media_bytes"), F.sha2(medium, 256).alias("media_sha256"), "feature",
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal size; equal texts together."""
    placed = sharding.assign(documents(spark, sf_dir), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    found = pii.detect(documents(spark, sf_dir))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every 256-id sequence in the training order, with the checksum of its ids, as written to shards."""
    to = f"{Scratch(spark, 'training-order').at}/shards"
    return training_order.materialise(documents(spark, sf_dir), vocabulary(), to, stride=256)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of each document, at 150 % of all words."""
    return mixing.mix(documents(spark, sf_dir), ratio=1.5, most=2)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors of every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity grade and rejection of each document."""
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.round("toxic_severity", 6).alias("severity"), F.col("toxic_rejected").alias("rejected"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 ids, with the checksum of each piece's ids."""
    pieces = pack(documents(spark, sf_dir), vocabulary(), capacity=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts and whether they pass 2,048."""
    counts = prefix_token_table(documents(spark, sf_dir), vocabulary())
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of whole texts, learned from labels that are not held out."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as four bytes after four rounds, with their errors and the codebooks' digest."""
    rows, books, _ = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return vector_codes.with_label_errors(rows).select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations whose first turns are those of every twentieth one."""
    turns = prefix_trie.turn_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.prefix_trie(prefix_trie.regrafted(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dup": op1_near_dup,
    "op2_media": op2_media,
    "op3_sharding": op3_sharding,
    "op4_pii": op4_pii,
    "op5_training_order": op5_training_order,
    "op6_mixing": op6_mixing,
    "op7_ann": op7_ann,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_quality": op11_quality,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.SQL, "op12_vector_codes": vector_codes.SQL, "op13_prefix_trie": prefix_trie.SQL}
