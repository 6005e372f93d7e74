"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; a stage's decisions take effect, so the next one sees
only what was kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import decontaminate, jaccard, lines, packing, toxicity
from folioworks.llm.tables import table, written

SEQUENCE = 2048
REPEATED = lines.Seldom(ratio=0.01, long_ratio=0.001, long_words=20, least_pages=3)


def _carried(docs: DataFrame, *read: str) -> DataFrame:
    """The columns that a stage reads, and all of them as one, so that none clashes with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), "text", *read)


def _restored(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of `docs` again, some of them new."""
    return found.select(*[new.get(c, F.col("text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learned from the labelled ones among `docs`, rejects go.

    Null and empty texts have the base rate of toxic labels as score and stay while that is below the threshold; repeated rows
    share one fate. Without labels of both classes, and in an empty table, nothing goes.
    """
    settings = toxicity.Settings()
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), settings)
    return _restored(toxicity.score(_carried(docs), machine, settings.threshold).filter("predicted = 0"), docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of their source's documents (and on ten at least) leave the texts, and so do those that
    REPEATED finds; documents that consist mostly of the latter are copies, which the next stage thins out.

    No document goes. A null text stays null, an empty one empty, a null source is a source of its own; repeated rows count
    as documents of their own. An empty table gives no rows.
    """
    found = lines.drop_boilerplate(_carried(docs, "source"), F.col("source"), lines.text_lines(F.col("text")), 0.1, 10, REPEATED)
    chars = F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("bigint")).otherwise(F.col("_row.n_chars"))
    return _restored(found, docs, text=F.col("kept"), n_chars=chars)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 one row stays, the one with the smallest id.

    Repeated rows count as copies, and so do rows without an id, of which one stays where no linked row has an id. A second,
    different text under an id is a document of its own. Texts without words all stay. An empty table gives no rows.
    """
    less = written(jaccard.surplus(docs, width=5, num=4, den=5), "surplus")
    keyed, both = jaccard.with_keys(_carried(docs, "doc_id")), ["row_id", "text_key"]
    kept = keyed.join(less.select(*both), both, "left_anti")
    repeated = less.filter("keep = 1").select(*both)
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, both, "left_semi").dropDuplicates(both))
    return _restored(kept, docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain ten consecutive words of a benchmark item go. Items of fewer words may be common words: a
    document that only holds such items goes if they cover half of its words or more.

    Null and empty texts have no words and stay; rows that share an id are judged by their own texts, so repeated rows
    share one fate; null ids are judged like any other. An empty table gives no rows, an empty benchmark removes none.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), size=10)
    long = F.exists("spans", lambda x: x["stop"] - x["start"] >= 10)
    leaked = found.filter(F.col("contaminated") & (long | (F.col("n_hit") * 2 >= F.col("n_words")))).select("doc_id", "text_key").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.xxhash64("d.text") == F.col("l.text_key"))
    return _restored(_carried(docs, "doc_id").alias("d").join(leaked.alias("l"), same, "left_anti"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 2048 ids.

    Null and empty texts are one piece, the end id alone; repeated rows and null ids are packed like any other. An empty
    table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, size=SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic), ("line_dedup", repeated_lines), ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks), ("packing", packed)]

# Toxicity and packing go by a trained model and a tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = {"pipeline": run}
PIPELINE_SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
