"""SimHash near-dedup with multi-index hashing.

A fingerprint has two segments of 32 bits.  Two fingerprints at 2 or fewer differing bits differ by at most one bit in the upper segment
or not at all in the lower one; so each fingerprint probes the upper table with its ball of radius 1 (33 values) and the lower
table with its own value, and complete distances are verified on what the tables return.  Only distinct fingerprints
take part, so exact copies cost nothing here.

A segment value that more than ``MOST_IN_BUCKET`` fingerprints share isn't probed pair by pair.  Every fingerprint that probes such a value
is dealt out to its 65 points at distance 0 or 1 instead; two fingerprints are within 2 exactly if they meet at a point,
and each point links those that meet there to the smallest of them.  This finds every link of those buckets too, in linear time.

Edge cases: null, empty and blank texts have fingerprint zero; one or two words form one shingle; rows that repeat a ``doc_id``
each get their own fingerprint; a null ``doc_id`` gets a fingerprint and the component of that fingerprint's other rows (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, remembered
from .components import components

RADIUS = 2
MOST_IN_BUCKET = 64
SEED = 42


def simhash(text: str | None, width: int = 3) -> int:
    """64-bit fingerprint: bit i is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        shingles = [line[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = [xxh64_intdigest(s, SEED) for s in shingles[at : at + (1 << 16)]]
        counts += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(shingles)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("simhash", tuple)
        for batch in batches:
            fp = np.array([simhash(t) for at in range(0, batch.num_rows, 128) for t in batch.column("text").slice(at, 128).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").transform(mapped, run, "doc_id long, fp long")


def links(distinct: DataFrame, most: int = MOST_IN_BUCKET) -> DataFrame:
    """Links (a, b) between the representatives of distinct (fp, rep) at RADIUS or fewer bits: enough for all components."""
    upper = F.shiftrightunsigned("fp", 32)
    lower = F.col("fp").bitwiseAND(0xFFFFFFFF)
    flag = F.lit(1 << 32)
    ball = F.array(F.lit(0), *[F.lit(1 << i) for i in range(32)])
    homes = distinct.select(F.explode(F.array(upper, lower + flag)).alias("key"), "fp", "rep")
    probes = distinct.select(F.explode(F.concat(F.transform(ball, lambda x: upper.bitwiseXOR(x.cast("long"))), F.array(lower + flag))).alias("key"), "fp", "rep")
    full = cut(homes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"))
    table = homes.join(full, "key", "left_anti").select("key", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    near = probes.join(table, "key").where((F.col("fp") != F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS))
    pairs = near.select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b"))
    hot = probes.join(full, "key", "left_semi").select("fp", "rep").distinct()
    points = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)])
    dealt = hot.select(F.explode(F.transform(points, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"), "rep")
    least = dealt.groupBy("point").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a > b").select("point", "b")
    met = dealt.join(least, "point").where("rep > b").select(F.col("rep").alias("a"), "b")
    return pairs.union(met).distinct()


def near_duplicates(docs: DataFrame, most: int = MOST_IN_BUCKET) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    marked = cut(fingerprints(docs))
    distinct = cut(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = components(links(distinct, most), "a", "b")
    of = distinct.join(parts, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: the smallest doc_id of each component stays, and rows without an id."""
    first = near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id IS NULL"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates over all documents."""
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
