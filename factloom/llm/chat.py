"""Chat formatting after collapsing cumulative snapshots.

Every prefix of a conversation has a hash that rolls on with each turn: the exclusive or of 128-bit hashes of (place, role,
text), so it can be summed in parts of a conversation and joined up, however long one is. A conversation whose whole
hash is some longer one's prefix hash is a snapshot of that and goes; of equal ones the least conv_id stays. What remains is rendered.

Defined results: turns are ordered by turn, role and text, nulls first; exactly repeated rows count once; a null role or text
counts as empty; a null conv_id is a conversation of its own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turn numbers that are put in order together.
SPAN = 64


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, place) with places from 1, and the hashes a and b of the prefix that ends there."""
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(2**63))).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Parts of a conversation are numbered first and joined up after; copies of a row meet only within their part.
    rows = rows.withColumn("part", F.floor(F.col("turn") / SPAN)).dropDuplicates(["conv", "part", "turn", "role", "text"])
    within = Window.partitionBy("conv", "part").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(within))
    sizes = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    rows = rows.join(sizes, ["conv", "part"]).withColumn("place", F.col("place") + F.col("skip"))
    for name, salt in (("a", 1), ("b", 2)):
        rows = rows.withColumn(f"h{name}", F.xxhash64(F.lit(salt), "place", "role", "text"))
    sums = rows.groupBy("conv", "part").agg(F.bit_xor("ha").alias("pa"), F.bit_xor("hb").alias("pb"))
    sums = sums.select("conv", "part", *[F.coalesce(F.bit_xor(f"p{x}").over(before), F.lit(0)).alias(f"p{x}") for x in "ab"])
    so_far = Window.partitionBy("conv", "part").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, ["conv", "part"])
    return rows.select("conv", "turn", "role", "text", "place", *[F.bit_xor(f"h{x}").over(so_far).bitwiseXOR(F.col(f"p{x}")).alias(x) for x in "ab"])


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n_turns, n_equal) of the conversations that no other continues."""
    lengths = turns.groupBy("conv").agg(F.max(F.struct("place", "a", "b")).alias("end"))
    ends = lengths.select("conv", "end.*").groupBy("place", "a", "b").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_equal"))
    inner = turns.join(lengths, "conv").filter(F.col("place") < F.col("end.place")).select("place", "a", "b").distinct()
    return ends.join(inner, ["place", "a", "b"], "left_anti").select("conv", F.col("place").cast("long").alias("n_turns"), "n_equal")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal and the rendered text of each maximal conversation."""
    turns = placed_turns(conversations)
    kept = turns.select("conv", "place", "role", "text").join(maximal(turns), "conv")
    kept = kept.groupBy("conv", "n_turns", "n_equal").agg(F.sort_array(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("x")))).alias("x"))
    return kept.select(F.when(F.col("conv") != -(2**63), F.col("conv")).alias("conv_id"), "n_turns", "n_equal", F.array_join(F.transform("x", lambda s: s["x"]), "").alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT conv_id, row_number() OVER w AS place, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS x
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), prefixes AS (
  SELECT conv_id, place, md5(string_agg(md5(x), ',') OVER (PARTITION BY conv_id ORDER BY place)) AS h,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed
), ends AS (
  SELECT min(conv_id) AS conv_id, place AS n_turns, h, count(*) AS n_equal FROM prefixes WHERE place = n GROUP BY place, h
), kept AS (
  SELECT conv_id, n_turns, n_equal FROM ends
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place = ends.n_turns AND p.h = ends.h AND p.place < p.n)
)
SELECT k.conv_id, k.n_turns, k.n_equal, string_agg(p.x, '' ORDER BY p.place) AS rendered
FROM kept k JOIN placed p ON p.conv_id = k.conv_id GROUP BY k.conv_id, k.n_turns, k.n_equal
"""
