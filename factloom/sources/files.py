"""Files in: TSV batches, manifest-driven folders, fixture corpora; JSON reports out; a content-addressed memo."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scan import import_specifiers
from factloom.functions.text import asset_kind, is_safe_path, resolution_candidates


def tsv(spark: SparkSession, path: str, columns: list[str], required: int, header: str | None = None) -> DataFrame:
    """Rows of a tab-separated batch with `line` and, for lines that break its shape, `error`; # comments, blank lines and the header are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "raw")).withColumn("line", F.col("line") + 1)
    rows = lines.filter((F.btrim("raw") != "") & ~F.col("raw").startswith("#"))
    if header:
        rows = rows.filter(F.lower(F.split("raw", "\t")[0]) != header.lower())
    parts = F.split("raw", "\t")
    rows = rows.withColumn("_n", F.size(parts))
    error = F.when((F.col("_n") < required) | (F.col("_n") > len(columns)), F.format_string("line %d: %d fields, expected %d to %d", "line", "_n", F.lit(required), F.lit(len(columns))))
    for c in columns[:required]:
        i = columns.index(c)
        error = F.coalesce(error, F.when(F.btrim(F.get(parts, i)) == "", F.format_string(f"line %d: {c} is blank", "line")))
    return rows.select("line", *[F.nullif(F.btrim(F.get(parts, i)), F.lit("")).alias(c) for i, c in enumerate(columns)], error.alias("error"))


MANIFEST = "files array<struct<path string, sha256 string, kind string>>"


def unpacked(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size, kind, dependencies, error) of the files that root's manifest.json lists, each held against its hash."""
    manifest = spark.read.text(f"{root}/manifest.json", wholetext=True).select(F.explode(F.from_json("value", MANIFEST)["files"]).alias("f")).select("f.*")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", r"[^/]+$", 0).alias("_name"), F.col("path").alias("_at"), "content", "length")
    joined = manifest.withColumn("_name", F.regexp_extract("path", r"[^/]+$", 0)).join(found, "_name", "left").filter(F.col("_at").isNull() | F.col("_at").endswith(F.concat(F.lit("/"), F.col("path"))))
    error = F.when(~is_safe_path(F.col("path")), "unsafe path").when(F.col("content").isNull(), "missing").when(F.col("sha256").isNotNull() & (F.sha2("content", 256) != F.lower("sha256")), "hash differs")
    kind = F.coalesce("kind", F.when(F.col("path").rlike(r"\.[cm]?[jt]sx?$"), "script").otherwise(asset_kind(F.col("path"))))
    return joined.select("path", "content", F.col("length").alias("size"), kind.alias("kind"), F.when(kind == "script", import_specifiers(F.col("content").cast("string"))).alias("specifiers"), error.alias("error"))


def dependencies(files: DataFrame) -> DataFrame:
    """(src, dst) between files: each relative specifier goes to the first candidate that exists."""
    asked = files.select(F.col("path").alias("src"), F.explode("specifiers").alias("specifier")).filter(F.col("specifier").rlike(r"^\.\.?(?:/|$)"))
    tried = asked.select("src", "specifier", F.posexplode(resolution_candidates(F.col("src"), F.col("specifier"))).alias("place", "dst"))
    there = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return there.groupBy("src", "specifier").agg(F.min_by("dst", "place").alias("dst")).select("src", "dst").distinct()


def corpus_cases(spark: SparkSession, root: str) -> DataFrame:
    """(case, file, content) of a fixture corpus laid out as <category>/<case>/..., in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.regexp_extract("path", r"([^/]+/[^/]+)/([^/]+(?:/[^/]+)?)$", 1)
    return files.select(tail.alias("case"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content").orderBy("case", "file")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def memoized(contents: DataFrame, memo: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(content_hash, fingerprint_json) of all contents (content string), and the rows to add to the memo: only misses and unreadable entries are computed."""
    keyed = contents.select(F.sha2("content", 256).alias("content_hash"), "content").dropDuplicates(["content_hash"])
    sound = memo.filter(F.expr("try_parse_json(fingerprint_json)").isNotNull()).dropDuplicates(["content_hash"])
    fresh = compute(keyed.join(sound.select("content_hash"), "content_hash", "left_anti")).select("content_hash", "fingerprint_json")
    known = sound.join(keyed.select("content_hash"), "content_hash", "left_semi").select("content_hash", "fingerprint_json")
    return known.unionByName(fresh), fresh
