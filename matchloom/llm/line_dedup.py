"""Line dedup with DataFrame functions only.

Lines are exploded to (two 64-bit hashes of the key, document), counted per hash with map-side combining, and the lines
of keys that more than one document holds come back as positions per document.  Only hashes and positions move in the
two line shuffles, never the lines.  The join of lines to repeated keys is a plain shuffled join, whose hot keys
adaptive execution splits.  Texts are reassembled by position in linear time.

Edge cases: a null or empty text is one empty line; rows with a null ``doc_id`` are returned whole and take no part in the counts;
rows that repeat a ``doc_id`` count as one document; any other columns stay out of the way (``dedup_lines`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY = 10
MIN_DOCUMENTS = 2


def line_key(line):
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_key: int = MIN_KEY, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with columns ``kept_text``, ``n_lines`` and ``n_dropped``.

    Keys of at least ``min_key`` code points that ``min_documents`` or more documents hold lose their lines everywhere but
    in the smallest ``doc_id`` among them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # internal names begin with __line_, so that no column of the input is in the way
    whole = docs.withColumns({"__line_lines": F.split(text, "\n", -1), "__line_version": F.xxhash64(text)})
    lines = (
        docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_key))
        .select("doc_id", F.xxhash64(text).alias("__line_version"), F.posexplode(F.transform(F.split(text, "\n", -1), line_key)).alias("__line_pos", "__line_key"))
        .where(F.char_length("__line_key") >= min_key)
        .select("doc_id", "__line_version", "__line_pos", F.xxhash64("__line_key").alias("__line_h1"), F.xxhash64(F.lit(1), "__line_key").alias("__line_h2"))
    )
    if min_documents <= 2:
        keys = lines.groupBy("__line_h1", "__line_h2").agg(F.min("doc_id").alias("__line_first"), F.max("doc_id").alias("__line_last")).where("__line_first < __line_last").drop("__line_last")
    else:
        per_document = lines.groupBy("__line_h1", "__line_h2", "doc_id").agg(F.lit(1).alias("__line_one"))
        keys = per_document.groupBy("__line_h1", "__line_h2").agg(F.min("doc_id").alias("__line_first"), F.count("*").alias("__line_n")).where(F.col("__line_n") >= min_documents).drop("__line_n")
    # cut, so that both sides of the join are exchanges of its own and adaptive execution can split a hot line's
    keys = cut(keys)
    drops = (
        lines.join(keys, ["__line_h1", "__line_h2"])
        .where("doc_id > __line_first")
        .groupBy(F.col("doc_id").alias("__line_doc"), F.col("__line_version").alias("__line_of"))
        .agg(F.collect_set("__line_pos").alias("__line_drop"))
    )
    joined = whole.join(drops, (F.col("doc_id") == F.col("__line_doc")) & (F.col("__line_version") == F.col("__line_of")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__line_lines") - 1), "__line_drop"), lambda i: F.get(F.col("__line_lines"), i))
    return joined.withColumns(
        {
            "n_lines": F.size("__line_lines").cast("long"),
            "n_dropped": F.coalesce(F.size("__line_drop"), F.lit(0)).cast("long"),
            "kept_text": F.when(F.col("__line_drop").isNull(), text).otherwise(F.array_join(kept, "\n")),
        }
    ).drop("__line_lines", "__line_version", "__line_doc", "__line_of", "__line_drop")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup over all documents."""
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), keys AS (
  SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.i, l.line, (k.k IS NOT NULL AND l.doc_id > k.first_doc) AS gone FROM lines l LEFT JOIN keys k ON l.k = k.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
