"""What the operators share: whole-text batches, ASCII words and packed blocks for shuffles."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import written

#: The white space of the contracts: \x20 and \x09-\x0D; bytes.split() and bytes.lower() keep to ASCII.
SPACE = " \t\n\x0b\f\r"

#: Bytes of text that one step of a Python worker holds at once.
STEP_BYTES = 4_000_000


@functools.cache
def frugal() -> None:
    """Once in a worker: what numpy and Arrow have freed goes back to the system, as workers stay on after their largest task."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 17)  # M_MMAP_THRESHOLD: blocks from this size are mapped, and unmapped when freed
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that matter, under fixed names: other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def steps(batches: Iterator[pa.RecordBatch], *also: str) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of bounded size; null texts come as empty ones. With further columns named, ids are tuples that hold these too."""
    frugal()
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        if also:
            ids = list(zip(ids, *[batch.column(c).to_pylist() for c in also], strict=True))
        for a, b in cuts(texts):
            yield ids[a:b], [x or "" for x in texts.slice(a, b - a).to_pylist()]


def cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts whose bytes are bounded, but for one long text at the end of a run."""
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    lengths = np.diff(np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1])
    at, size = 0, 0
    for i, n in enumerate(lengths):
        size += int(n)
        if size >= STEP_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def filtered(docs: DataFrame, text_col: str, keep: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of docs, with all their columns, whose texts `keep()` keeps. Rows are judged where they are: nothing is shuffled or joined, and ids don't matter."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    place = docs.columns.index(text_col)
    # The text that is judged, beside the row as it is.
    rows = rows.withColumn("judged", F.col(names[place]).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        verdict = keep()
        for batch in batches:
            texts = batch.column("judged")
            for a, b in cuts(texts):
                chosen = pa.array(verdict([x or "" for x in texts.slice(a, b - a).to_pylist()]), pa.bool_())
                yield batch.slice(a, b - a).select(names).filter(chosen)

    return rows.mapInArrow(run, rows.drop("judged").schema).toDF(*docs.columns)


def one_text_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, y, text) for the rows (doc_id, y): of the texts of one id that whose hash is least, so that there are no more rows than were asked for."""
    found = docs.join(F.broadcast(rows), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))).alias("text"))


def attach(rows: DataFrame, values: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """rows joined with values, unique by `on`, however many rows share a key. Give written tables: both are read twice.

    Keys with more rows than an even share of a task are no more than there are tasks; their values go to the rows. All others join by shuffle.
    """
    parts = shuffle_buckets(rows.sparkSession)
    counts = rows.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_rows"))
    total = rows.count()
    hot = written(counts.filter(F.col("_rows") > max(256, total // parts)).select(on))
    if hot.isEmpty():
        return rows.join(values, on, how)
    hot_values = values.join(F.broadcast(hot), on, "left_semi")
    # Below parts + 1 keys by the filter above.
    mine = rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_values), on, how)
    return rows.join(F.broadcast(hot), on, "left_anti").join(values, on, how).unionByName(mine)


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, then runs of anything but ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of `width` words, in order; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
        out = out ^ (out >> np.uint64(29))
    return mixed(out)


#: Spark takes what it doesn't know the size of for endless.
UNKNOWN = 1 << 60


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of the buckets a hash belongs to, by its top 31 bits."""
    return ((hashes >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


def by_bucket(to: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of what each bucket gets, places in order."""
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in range(buckets):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def held_out_remainder(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def crc_mod(id_col: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts


def shuffle_buckets(spark: SparkSession, read: DataFrame | None = None) -> int:
    """As many packed buckets as the session deals its shuffles to, and one for each 10 MB of the files that `read` reads: what grows with the data is their number, not their size."""
    least = 0
    if read is not None:
        leaves = read._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        least = sum(x for x in sizes if x < UNKNOWN) // 10_000_000
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), least)
