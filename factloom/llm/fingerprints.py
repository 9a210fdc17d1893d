"""Threshold-scaled document sketches on DataFrame functions alone.

A sketch keeps every 5-word shingle hash below a fixed fraction of the hash space, so sketches of any two documents, or
the union of many, sample the same part of that space: likeness and containment come from plain set sizes, however
unequal the documents are. A document that would keep none keeps its smallest hash, so that no text with words is
without a sketch.

Defined results: texts are lower-cased and cut at ASCII white space; fewer than five words make one shingle; a null or
empty text has an empty sketch; two empty sketches are alike by 1, an empty and another by 0. Documents follow each other by
descending doc_id, then by a hash of the text; null ids come last; equal rows share their successor. A table of one document is
followed by itself; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import documents

#: Of the hash space; a power of two.
FRACTION = 1 / 8
WIDTH = 5
#: Ranges of ids that are put in order apart from each other.
RANGES = 256


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def with_sketch(df: DataFrame, text: Column, name: str, fraction: float = FRACTION, width: int = WIDTH) -> DataFrame:
    """df and the sorted kept hashes of `text` as array<bigint>. Word hashes get a column of their own: each word is hashed once."""
    top_bits = 64 - round(-math.log2(fraction))
    df = df.withColumn("_w", F.transform(words(text), lambda w: F.xxhash64(w)))
    n = F.size("_w")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(width)]))
    df = df.withColumn("_s", F.when(n == 0, F.array().cast("array<bigint>")).otherwise(windows))
    df = df.withColumn("_k", F.array_distinct(F.filter("_s", lambda h: F.shiftrightunsigned(h, top_bits) == 0)))
    kept = F.when((F.size("_k") == 0) & (F.size("_s") > 0), F.array(F.array_min("_s"))).otherwise(F.array_sort("_k"))
    return df.withColumn(name, kept).drop("_w", "_s", "_k")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds too; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def sampled(sketch: Column, fraction: float = FRACTION) -> Column:
    """The sketch without the hash that stands in for a text that kept none: what is left is a sample by the threshold alone."""
    return F.filter(sketch, lambda h: F.shiftrightunsigned(h, 64 - round(-math.log2(fraction))) == 0)


def merged(df: DataFrame, keys: list[str], sketch: str, fraction: float = FRACTION) -> DataFrame:
    """Sketches of unions of documents, by the threshold alone; partial sets combine before the shuffle. A union without a hash below it has no row."""
    each = df.select(*keys, F.explode(sampled(F.col(sketch), fraction)).alias("_h")).distinct()
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def _range_of(x: Column, bounds: list) -> Column:
    """How many bounds x doesn't exceed, by halving; larger values come first."""
    if not bounds:
        return F.lit(0)
    at = len(bounds) // 2
    return F.when(x > F.lit(bounds[at]), len(bounds) - at + _range_of(x, bounds[at + 1 :])).otherwise(_range_of(x, bounds[:at]))


def successors(keys: DataFrame) -> DataFrame:
    """keys (_id, _h, ...) with _next_id and _next_h: by descending _id and ascending _h, the last one followed by the first.

    Only keys are put in order, in RANGES parts of about equal size; the parts' first rows join them up.
    """
    cuts = [i / RANGES for i in range(1, RANGES)]
    found = keys.agg(F.percentile_approx("_id", cuts)).first()[0]
    bounds = sorted(set(found or []))
    parts = keys.withColumn("_part", -_range_of(F.col("_id"), bounds))
    order = [F.col("_id").desc(), F.col("_h").asc()]
    within = Window.partitionBy("_part").orderBy(*order)
    rows = parts.withColumn("_next", F.lead(F.struct("_id", "_h")).over(within))
    # A row for each part; at most RANGES of them.
    heads = parts.groupBy("_part").agg(F.min(F.struct((-F.col("_id").cast("decimal(20,0)")).alias("o"), F.col("_h").alias("h"), F.col("_id").alias("i"))).alias("_m")).select("_part", F.struct(F.col("_m.i").alias("_id"), F.col("_m.h").alias("_h")).alias("_head"))
    line = Window.orderBy("_part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("_follows", F.coalesce(F.lead("_head").over(line), F.first("_head").over(whole))).drop("_head")
    rows = rows.join(F.broadcast(heads), "_part").withColumn("_next", F.coalesce("_next", "_follows"))
    return rows.select(*keys.columns, F.col("_next._id").alias("_next_id"), F.col("_next._h").alias("_next_h"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Each document with its sketch, its edited text (the last third replaced by its successor's beginning) and the successor's sketch.

    Texts move once: both joins read the same exchange by key; besides, at most a third of each text moves as a replacement.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_h", F.xxhash64("text"))
    order = successors(base.groupBy("_id", "_h").agg(F.first(F.floor(F.char_length("text") / 3).cast("int")).alias("_take")))
    # Both joins below read all four columns, so they share one exchange; the id comes back from _id.
    rows = with_sketch(base.select("_id", "_h", "text"), F.col("text"), "sketch", fraction)
    asked = order.select(F.col("_id").alias("_for_id"), F.col("_h").alias("_for_h"), F.col("_next_id").alias("_id"), F.col("_next_h").alias("_h"), "_take")
    given = rows.join(asked, ["_id", "_h"])
    given = given.select(F.col("_for_id").alias("_id"), F.col("_for_h").alias("_h"), "_take", F.substring(F.col("text"), F.lit(1), F.col("_take")).alias("_new"), F.col("sketch").alias("next_sketch"))
    given = given.dropDuplicates(["_id", "_h"])
    out = rows.join(given, ["_id", "_h"]).withColumn("n_chars", F.char_length("text"))
    out = out.withColumn("doc_id", F.when(F.col("_id") != -(2**63), F.col("_id")))
    return out.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - F.col("_take")), F.col("_new"))).drop("_id", "_h", "_take", "_new")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_sketch(edited_pairs(documents(spark, sf_dir)), F.col("edited"), "edited_sketch")
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
    )
