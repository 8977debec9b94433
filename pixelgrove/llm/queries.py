"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pixelgrove.llm.common import documents


#: Score from which a document counts as good.
QUALITY_THRESHOLD = 0.3


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelgrove.llm.exact_dedup import exact_dedup

    out = exact_dedup(documents(spark, sf_dir), keep="largest")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelgrove.llm.packing import pack

    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pixelgrove.llm.byte_bpe import decode, encode, read_ranks

    ranks = read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    out = decode(encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelgrove.llm.fingerprints import edited_and_next

    return edited_and_next(documents(spark, sf_dir))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelgrove.llm.secrets import labelled_samples, scan, train

    out = scan(documents(spark, sf_dir), train(labelled_samples(spark)))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_markov")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelgrove.llm.toxicity import SAMPLE_ROWS, score, train
    from pixelgrove.llm.training import held_out, labelled_rows

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(labelled_rows(docs, labels, "toxic", ~held_out(F.col("doc_id"), 3, 1), SAMPLE_ROWS))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelgrove.llm.quality import SAMPLE_ROWS, score, train
    from pixelgrove.llm.training import held_out, labelled_rows

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(labelled_rows(docs, labels, "quality", ~held_out(F.col("doc_id"), 5, 0), SAMPLE_ROWS))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelgrove.llm.near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), shingle=3, percent=85).drop("text_key")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelgrove.llm.html_text import extract

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its licenses, and each finding as license:start:end:differing words."""
    from pixelgrove.llm.licenses import scan

    found = F.col("findings")
    listed = F.transform(found, lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), x["differences"].cast("string")))
    names = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["license"])))
    return scan(documents(spark, sf_dir)).select("doc_id", F.size(found).cast("long").alias("n_findings"), F.array_join(names, ",").alias("licenses"), F.array_join(listed, ",").alias("findings"))


QUERIES = {"op4_html_extraction": op4_html_extraction, "op8_license_scans": op8_license_scans, "op1_near_dedup": op1_near_dedup, "op5_quality": op5_quality, "op2_toxicity": op2_toxicity, "op9_secret_scans": op9_secret_scans, "op6_fingerprints": op6_fingerprints, "op3_byte_bpe": op3_byte_bpe, "op10_exact_dedup": op10_exact_dedup, "op7_packing": op7_packing}
SQL = {"op10_exact_dedup": OP10_SQL}
