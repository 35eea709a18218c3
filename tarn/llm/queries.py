"""The thin ``opN_<name>`` queries: each applies its operator to a whole table.

Nulls, empty and long texts, repeated rows and empty tables are as the operator's
docstring says; a query adds no case of its own. Columns of the table that the
operator doesn't name never reach it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import small_batches
from tarn.sources.tables import spread, table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one is dealt out to all cores. The session's Arrow batches are held small."""
    small_batches(spark)
    return spread(table(spark, sf_dir, name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document; see ``quality_rules``."""
    from tarn.llm.quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents")).drop("failed_rule")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's five highest inner products; ties to the smaller id; see ``top_k``."""
    from tarn.llm.topk import quantised, top_k

    vectors = quantised(read(spark, sf_dir, "embeddings"), 256.0)
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every text's tokens, digest of the text they decode to; see ``encode``."""
    from tarn.llm.bpe_codec import encode

    coded = encode(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, and if its label was kept from training; see ``score``."""
    from tarn.llm.quality_cnn import fit, fold, score

    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text; see ``count_tokens``."""
    from tarn.llm.token_count import count_tokens

    counted = count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and digests of both derivatives of every page; see ``derivatives``."""
    from tarn.llm.warc import derivatives, responses

    made = derivatives(responses(read(spark, sf_dir, "pages")))
    return made.select(
        "page_id",
        "response_id",
        "target_uri",
        "metadata_id",
        "conversion_id",
        "refers_to",
        "response_digest",
        "conversion_digest",
        F.octet_length("conversion_block").cast("long").alias("text_bytes"),
        F.sha2("metadata_record", 256).alias("metadata_sha256"),
        F.sha2("conversion_record", 256).alias("conversion_sha256"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see ``near_duplicates``."""
    from tarn.llm.simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped, digest of those kept; see ``line_dedup``."""
    from tarn.llm.line_dedup import line_dedup

    found = line_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those removed, digest of those kept; see ``substring_dedup``."""
    from tarn.llm.substring_dedup import substring_dedup

    found = substring_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document's tokens with its place in a sequence; see ``token_pieces`` and ``pack``."""
    from tarn.llm.packing import pack, token_pieces

    pieces = token_pieces(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under two tokenizers; see ``align``."""
    from tarn.llm.alignment import align

    return align(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans' number and digest, and all spans, of every document; see ``personal_data``."""
    from tarn.llm.pii import KINDS, personal_data

    found = personal_data(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join("base", ",").cast("binary"), 256)
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], digest.alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words' number, form and root; see ``spelling_variants``."""
    from tarn.llm.spelling import spelling_variants

    return spelling_variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_topk": op2_topk,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_quality_cnn": op4_quality_cnn,
    "op5_token_count": op5_token_count,
    "op6_line_dedup": op6_line_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_personal_data": op12_personal_data,
    "op13_spelling": op13_spelling,
}
