"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import arrays, chat_tree, jaccard_join, licenses, merge_dropout, merkle, quality, simhash, spotsigs, suffix_dedup, templates, token_store, toxicity, whitening


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that any document repeats, also with other numbers, names or units."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return templates.leaks(docs, items)


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text beside its edited form and the next text."""
    return spotsigs.compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*more.columns).union(more)
    return chat_tree.read_back(*chat_tree.build(rows, path), path)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a fifth of the ids teach nothing."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_texts(docs.select("doc_id", "text"), labels, learn=_remainder(5) != 0)
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a quarter of the ids teach nothing."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score_texts(docs.select("doc_id", "text"), labels, learn=_remainder(4) != 2)
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_license_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence texts and notices that are a whole document or a whole line of one."""
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), licenses.known(spark))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all candidate merges is skipped."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = merge_dropout.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), 0.1, 1)
    return out.select("doc_id", "pieces", "n_tokens", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "lossless")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level pieces, id 2 after each document."""
    import public_tokenizers

    arrays.short_batches(spark)
    folder = token_store.new_folder(spark)
    shards = token_store.write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_store.read_store(shards, folder)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes."""
    arrays.short_batches(spark)
    out = suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9 and more."""
    return jaccard_join.link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every usable vector and each of the first eight components."""
    out, model, error = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    n, shares = (model.n, (model.values / model.trace).tolist()) if model and model.trace else (0, [])
    each = out.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("at"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, at most three differing bits."""
    return simhash.link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all rows by language; a third of the rows is tampered with and folded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(_remainder(3) == 0, merkle.leaf(*columns[:-1], lowered))
    manifest = merkle.build(docs.select("doc_id", "lang", merkle.leaf(*columns).alias("leaf"), tampered.alias("tampered")), "lang", "doc_id")
    return merkle.fold(manifest, "tampered").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op2_spotsigs": op2_spotsigs, "op3_chat_tree": op3_chat_tree, "pipeline": corpus_pipeline.run, "op5_quality": op5_quality, "op6_license_lookup": op6_license_lookup, "op7_merge_dropout": op7_merge_dropout, "op1_decontamination": op1_decontamination, "op4_toxicity": op4_toxicity, "op8_token_store": op8_token_store, "op9_suffix_dedup": op9_suffix_dedup, "op10_jaccard_join": op10_jaccard_join, "op11_whitening": op11_whitening, "op12_simhash": op12_simhash, "op13_merkle": op13_merkle}
