"""A training corpus from raw documents: quality, near-duplicates, repeated passages, source weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each stage's rows to the
shared scratch folder as Parquet and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import importance, minhash_dedup, mixing, packing, passage_dedup
from tessera.llm.common import materialise, row_key, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _matching(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, rid) stands in kept."""
    marked = docs.withColumn("_rid", row_key(docs, "doc_id", "text"))
    on = marked["doc_id"].eqNullSafe(kept["doc_id"]) & (marked["_rid"] == kept["rid"])
    return marked.join(kept.hint("shuffle_hash"), on, "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards clean labelled text draws.

    Rows that share an id are drawn apart by their text; rows repeated as a whole stay or go together. Null and empty texts have
    no n-grams and weigh 0. Equal keys are broken by the row's hash. Without documents or labels of both kinds see resample().
    """
    drawn = importance.resample(docs, table(spark, sf_dir, "labels")).where("kept").select("doc_id", "rid").distinct()
    return _matching(docs, drawn)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: a row with the smallest id. Texts without words are in no group and stay."""
    found = materialise(minhash_dedup.near_duplicates(docs, with_keys=True).where("kept").select("doc_id", "rid", "component"), "kept")
    # all kept rows of a component have one id, or none: of several rows the one with the smallest key stays
    chosen = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "rid")).alias("row"), F.count("*").alias("n"))
    one = _matching(docs, chosen.select("row.doc_id", "row.rid"))
    # a row may be there several times as a whole
    one = one if chosen.where("n > 1").isEmpty() else one.dropDuplicates(["doc_id", "text"])
    return one.unionByName(_matching(docs, found.where("component is null").select("doc_id", "rid").distinct()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of over 50 words that repeat; n_chars follows the text where it was cut.

    Null texts stay null; rows repeated as a whole are each other's repeats; an empty table gives no rows.
    """
    cut = passage_dedup.remove_passages(docs, keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("words_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (0, 1 or 2); texts without words, null ones too, add nothing to a mix and go.

    A null source is a source of its own; of equal rows a part may be taken. An empty table gives no rows.
    """
    chosen = mixing.mix(docs, keep=("text", "lang", "source", "n_chars")).where("taken > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("taken") / F.col("size")).cast("long")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each with its sequence and place in it.

    Null and empty texts are packed as their end id alone; repeated rows are documents of their own. An empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_weights),
    ("packing", packed),
]

#: SQL expresses none of the first three stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
