"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import ann_forest, byte_bpe, divergence, exact_dedup, language_id, line_dedup, merkle, ngram_join, packing, quality, sharding, token_counts, url_filter


#: The document that a page shows: the last number of its path.
SHOWN = "try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)[^/?#0-9]*/?([?#]|$)', 1) AS bigint)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join(_table(spark, sf_dir, "documents"), size=4, threshold=0.85)
    return joined.select("doc_id", "n_shingles", "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.measure(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: (verdict, host and path) of the hand-made rules.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; what its pages declare in markup and address, where it has some, or else its source alone.

    The last number of a page's path is the id of the document that it shows; all pages that show one count.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = language_id.page_evidence(_table(spark, sf_dir, "pages").select("url", "html"))
    said = pages.select(F.expr(SHOWN).alias("doc_id"), "declared", "suffix", "host")
    model = language_id.fit(docs, "lang")
    scored = language_id.text_scores(docs, model).drop("text")  # no text is shuffled
    judged = language_id.fuse_pages(scored, said, model, label="lang", host="source")
    return judged.select("doc_id", F.col("li_language").alias("language"), F.round("li_confidence", 6).alias("confidence"), F.col("li_text").alias("text_language"), F.col("li_kept").alias("kept"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels are those of the document that a page shows, whose id is the last number of the page's path."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = pages.select("page_id", F.expr(SHOWN).alias("doc_id")).join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return url_filter.judge(pages, known, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the numbers of its lines to remove."""
    docs = _table(spark, sf_dir, "documents")
    judged = line_dedup.judged(docs)
    return judged.select(F.col("id").alias("doc_id"), F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded from its digest or, where it was tampered with, from that of its text in small letters."""
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.digest([small if c == "text" else F.col(c) for c in fields]))
    manifest = merkle.build(docs, fields, ["lang"], ["doc_id"], carry={"doc_id": F.col("doc_id"), "tampered": tampered})
    rows, root = manifest.proofs(), F.lit(manifest.root).cast("string")
    out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == root)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part `pair`: every two sources of a language. Part `term`: the 200 terms that mark a source most."""
    audit = divergence.Audit(_table(spark, sf_dir, "documents"))
    pairs = audit.pairs().select(F.col("part").alias("lang"), F.col("name").alias("source"), F.lit("pair").alias("part"), F.col("peer").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = divergence.top_terms(audit.terms(), 200)
    terms = terms.select(F.col("part").alias("lang"), F.col("name").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = exact_dedup.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_sharding, op3_ann_forest, op4_quality_rules, op5_token_counts, op6_packing, op7_language_id, op8_url_filter, op9_line_dedup, op10_byte_bpe, op11_merkle_manifest, op12_source_divergence, op13_exact_dedup)}
