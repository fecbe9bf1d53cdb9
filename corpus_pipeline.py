"""A corpus cleaned and packed: toxicity, line dedup, SimHash near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet to the shared folder
and reads them again for the next.  All stages but the last return the columns of ``documents``, with ``n_chars`` the
length of the text as it then is.  Rows whose text a stage leaves empty go on as empty documents; SimHash near-dedup keeps one.

Edge cases, for every stage: an empty table gives an empty one; a null text counts as empty; a row with a null ``doc_id`` is judged by its own text
alone (the toxicity model scores it, no other document makes it lose lines or passages, and it is never dropped as a copy), and goes on; rows that
repeat a ``doc_id`` are one document to line and passage dedup, and all stay if that id stays; columns beside those of ``documents`` are left behind, whatever their names;
texts of any length are read whole; of equal lines, copies and passages the smallest ``doc_id`` keeps its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import line_dedup, packing, simhash, substring_dedup, toxicity
from matchloom.llm.common import discard, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    changed = docs.withColumn("text", F.col(text)).withColumn("n_chars", F.char_length("text").cast("long"))
    return changed.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    return _with_text(line_dedup.dedup_lines(docs.select(*COLUMNS)), "kept_text")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; texts without any keep their white space."""
    cleaned = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    return _with_text(cleaned.withColumn("kept_text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.coalesce("text", F.lit("")))), "kept_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_copies), ("substring_dedup", drop_passages), ("packing", pack)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs; it reads the table of the stage before, which stays in the shared folder, and the others are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
