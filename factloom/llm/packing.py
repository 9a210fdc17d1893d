"""Best-two-fit packing of token pieces into sequences.

The sizes to pack are whole numbers up to the sequence length, so a histogram of them, which never has more rows than
that, says all a packer needs. The plan is made on it: a bin is filled greedily with the largest sizes that fit, then its
smallest piece gives way to the two unpacked ones that fill the widened gap best; the same bin is repeated as long as its sizes
last. Pieces then find their place by their rank among the pieces of their size, counted in small salted groups.

Defined results: a null text counts as empty and still has its closing id; rows with the same doc_id are packed as
documents of their own; null ids are allowed; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import documents, id_and_text, steps
from factloom.session import written

LENGTH = 2048
CLOSING_ID = 0
#: Pieces of one size whose ranks are counted together, and how many such groups a size has at most.
GROUP, GROUPS = 256, 1 << 16


class Slots(NamedTuple):
    """Pieces of `size` with ranks first to first + count - 1 go, `each` to a sequence, to sequences from `sequence` on, from `offset` on."""

    size: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], length: int = LENGTH) -> list[Slots]:
    """Bins for counts[size] pieces of each size. Every bin exhausts a size or most of it before the next kind of bin is sought."""
    left = np.zeros(length + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    sizes = np.arange(length + 1)
    used, out, sequence = np.zeros(length + 1, np.int64), [], 0
    while left.any():
        chosen = _best_two(left, _greedy(left, length), length, sizes)
        kinds, each = np.unique(chosen, return_counts=True)
        times = int((left[kinds] // each).min())
        offset = 0
        for size, m in zip(kinds[::-1].tolist(), each[::-1].tolist(), strict=True):
            out.append(Slots(size, int(used[size]), times * m, m, sequence, offset))
            used[size] += times * m
            left[size] -= times * m
            offset += size * m
        sequence += times
    return out


def _greedy(left: np.ndarray, length: int) -> list[int]:
    gap, chosen, top = length, [], length
    while gap:
        there = np.flatnonzero(left[: min(gap, top) + 1])
        if not len(there):
            break
        top = int(there[-1])
        n = min(gap // top, int(left[top]))
        chosen += [top] * n
        gap -= n * top
        top -= 1
    return chosen


def _best_two(left: np.ndarray, chosen: list[int], length: int, sizes: np.ndarray) -> list[int]:
    """The smallest of the bin for the two unpacked sizes that fit its widened gap most tightly, where that is tighter."""
    gap = length - sum(chosen)
    if not gap or len(chosen) < 2:
        return chosen
    small = min(chosen)
    room = gap + small
    free = left[: room + 1].copy()
    for x in chosen:
        if x <= room:
            free[x] -= 1
    # The other two come from what the bin doesn't hold; the smallest itself would be no change.
    below = np.maximum.accumulate(np.where(free > 0, sizes[: room + 1], 0))
    firsts = np.flatnonzero(free[1:] > 0) + 1
    firsts = firsts[firsts < room]
    if not len(firsts):
        return chosen
    seconds = below[np.minimum(room - firsts, firsts)]
    twice = (seconds == firsts) & (free[firsts] < 2)
    seconds[twice] = below[firsts[twice] - 1]
    total = np.where(seconds > 0, firsts + seconds, 0)
    k = int(total.argmax())
    if total[k] <= small:
        return chosen
    rest = list(chosen)
    rest.remove(small)
    return [*rest, int(firsts[k]), int(seconds[k])]


@functools.lru_cache(2)
def tokenizer(path: str):
    """text -> ids as the tokenizers library gives them, by tiktoken where the same vocabulary lies beside as ranks (tests hold the two against each other)."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(path)
    library = lambda text: np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    ranks_path = re.sub(r"\.json$", ".tiktoken", path)
    if not os.path.exists(ranks_path):
        return library
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items() if t.special}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    # A run of white space this long could exhaust the stack of tiktoken's pattern matcher.
    deep = re.compile(r"\s{5000}")

    def ids(text: str) -> np.ndarray:
        return library(text) if deep.search(text) else fast.encode_to_numpy(text, allowed_special="all")

    return ids


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, closing: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """The token pieces of each document: its ids and the closing id, cut so that only the first piece may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for doc_ids, texts in steps(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = np.append(encode(text), closing).astype("<u4")
                short = len(ids) % length or length
                cuts = [0, *range(short, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], PIECES_NAMES)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


PIECES_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def place(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows (with doc_id, piece and length columns) and where each goes: sequence_id and offset. rows is read twice: give a written table."""
    spark = rows.sparkSession
    # One row for each size: at most `length` of them.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Full pieces, the bulk of a large corpus, are sequences by themselves and need no rank: any numbers above the others will do.
    counts.pop(length, None)
    slots = plan(counts, length)
    after = max((s.sequence + -(-s.count // s.each) for s in slots), default=0)
    full = rows.filter(F.col("length") == length).select("*", (F.monotonically_increasing_id() + after).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = rows.filter(F.col("length") < length)
    groups = F.element_at(F.array(*[F.lit(min(GROUPS, max(1, counts.get(i, 0) // GROUP))) for i in range(1, length + 1)]), F.col("length").cast("int"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), groups))
    sizes = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = rows.withColumn("_rank", rank - 1).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # A few rows for each kind of bin; kinds are bounded by the sizes, not by the documents.
    table = spark.createDataFrame([tuple(s) for s in slots] or [], "length long, _first long, _count long, _each long, _sequence long, _offset long")
    at = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(table), "length").filter((at >= 0) & (at < F.col("_count")))
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor(at / F.col("_each"))).withColumn("offset", F.col("_offset") + at % F.col("_each") * F.col("length")).select(*rows.drop("_salt").columns, "sequence_id", "offset")
    return placed.unionByName(full)


def pack(docs: DataFrame, path: str, length: int = LENGTH, closing: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Every piece with its ids, its sequence and its offset there."""
    return place(written(pieces(docs, path, length, closing, id_col, text_col, with_ids)), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")
