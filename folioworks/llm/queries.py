"""The queries of this subpackage by name, with production parameters; SQL counterparts in `oracles`."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import (
    chat, decontaminate, grammar_store, jaccard, lines, packing, quality, repetition, spelling, token_counts, topk, toxicity, whitening)
from folioworks.llm.oracles import ORACLES  # noqa: F401  for the entry module
from folioworks.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "word_bpe_49k.json"


def op1_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op3_quality_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_grammar_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document in grammar-compressed blocks, read back."""
    blocks = grammar_store.write_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=2)
    return grammar_store.read_documents(blocks)


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=0, size=2048)


def op6_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of ten benchmark words."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.drop("text_key", "spans")


def op7_signature_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by three-word shingles at 0.9."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=2048)


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of the conversations that begin no longer one."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's visible lines without its host's boilerplate."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = lines.drop_boilerplate(pages, lines.url_host(F.col("url")), lines.html_lines(F.col("html")), 0.1, 3)
    return found.select("page_id", "host", "n_lines", "n_dropped", "kept")


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first four whitened coordinates."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=4, scale=256.0)


def op12_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document repeats, and whether it is kept."""
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its near words and its most frequent form."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_toxicity_machine, op2_segment_topk, op3_quality_kernel, op4_grammar_store, op5_best_two_fit, op6_prefix_filter,
    op7_signature_forest, op8_token_counts, op9_chat_snapshots, op10_site_lines, op11_cholesky_whitening, op12_repetition_rules,
    op13_spelling_variants)}
