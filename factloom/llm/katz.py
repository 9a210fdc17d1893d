"""A Katz backoff model of word pairs, counted over the corpus and evaluated on every text.

Words are lower-cased runs between ASCII white space, and each text ends with one end token. Every word of the training rows is a
context and a continuation of its own, and the chain backs off per token:

    P(g | h) = d(c(h, g)) c(h, g) / c(h)     where the pair was seen
             = alpha(h) P(g)                  otherwise, alpha(h) being what the discounts leave, over the P of unseen g
    P(w)     = d(c(w)) c(w) / N               and what is left is the probability of any unknown word

Discounts d are Good-Turing's for counts up to 5 (Katz's renormalised form). For every context the probabilities of all
words, the unknown included, add up to 1.

Counts travel as sorted, packed blocks, by word or by pair; contexts that hold much of the corpus are spread over several
blocks. Single and pair counts are written as tables partitioned by block. Every text meets the tables again by block; pairs that are
frequent enough to be among HEADS pairs are scored where the text is. Pairs of two of the HEADS most frequent words go by places among
these. A pair with another word (a wide pair) goes by hashes: the block of its continuation adds the single count, then the block of its
context holds the pair, and what the context leaves is worked out there. HEADS bounds only what is broadcast.

Defined results: a null or empty text is one end token; without training rows every token is unknown and has
probability 1; null ids count as the empty text for the split; repeated rows are texts of their own; an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bucket_of, by_bucket, documents, held_out_remainder, id_and_text, mixed, shuffle_buckets, steps, word_hashes, words_of
from factloom.session import written

#: Words that every worker knows, and pairs that are scored without a shuffle: bounds for what is broadcast.
HEADS = 1 << 18
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens that a worker gathers before it hands them on.
FLUSH = 2_000_000
#: Sums of logarithms travel as whole numbers of this size.
UNIT = 2.0**-30
LOW48 = np.uint64((1 << 48) - 1)
#: Marks the key of a word that is not among the heads: the low bits of its hash.
RARE = np.uint64(1 << 48)


def pack(*columns: np.ndarray) -> bytes:
    """Whole-number columns of one length as compressed byte planes; the first is sorted and goes as differences."""
    n = len(columns[0])
    planes = [np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0)), *[c.astype(np.int64).view(np.uint64) for c in columns[1:]]]
    raw = b"".join(np.ascontiguousarray(p.astype("<u8").view(np.uint8).reshape(n, 8).T).tobytes() for p in planes)
    return n.to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:], max_output_size=max(1, 8 * n * columns)), np.uint8).reshape(columns, 8, n)
    out = [np.ascontiguousarray(raw[k].T).view("<u8").ravel() for k in range(columns)]
    return [np.cumsum(out[0], dtype=np.uint64), *[x.view(np.int64) for x in out[1:]]]


def good_turing(n: dict[int, float], top: int = DISCOUNTED) -> np.ndarray:
    """Discount factors by count: [0] unused, 1 beyond `top`. Where the counts of counts give none below 1, half a count is taken off."""
    d = np.ones(top + 2)
    common = (top + 1) * n.get(top + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, top + 1):
        value = 0.0
        if n.get(r) and common < 1:
            value = ((r + 1) * n.get(r + 1, 0) / n[r] / r - common) / (1 - common)
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def counted(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the sums of their counts."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    if counts is None:
        return values[starts], np.diff(np.append(starts, len(values)))
    return values[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def tokens(text: str) -> np.ndarray:
    return word_hashes(words_of(text))


class Model(NamedTuple):
    """What every worker needs (bounded by HEADS), and the tables by block."""

    buckets: int
    train_tokens: int
    types: int
    frequent: np.ndarray  # sorted hashes of the heads
    counts: np.ndarray  # of heads, then of all others, of the end and of the start as contexts
    single: np.ndarray  # log10 P of heads, of all others and of the end
    alpha: np.ndarray  # log10 by head
    discount1: np.ndarray
    discount2: np.ndarray
    flat: np.ndarray  # contexts whose pairs all have large counts lose half a count from each
    unknown: float  # log10 P of any unknown word
    spread: np.ndarray  # blocks of each context
    pairs: np.ndarray  # codes of frequent pairs, sorted
    pair_logs: np.ndarray
    unigrams: DataFrame
    bigrams: DataFrame
    wide: DataFrame

    @property
    def heads(self) -> np.ndarray:
        """Hashes of all words with contexts of their own, which are those of the training rows; for small tables, as they come to the driver."""
        return np.concatenate([np.zeros(0, np.uint64), *[unpack(r["block"], 2)[0] for r in self.unigrams.select("block").collect()]])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.train_tokens + 0.1 * (self.types + 1)))

    def rare_log(self, c: np.ndarray) -> np.ndarray:
        """log10 P(w) by training counts; 0 is any unknown word."""
        d = self.discount1[np.minimum(c, DISCOUNTED + 1)]
        return np.where(c > 0, np.log10(np.maximum(d * c, 1e-300) / max(1, self.train_tokens)), self.unknown)

    def pair_log(self, code: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(g | h) by pair counts."""
        k = np.uint64(len(self.frequent) + 3)
        h, g = (code // k).astype(np.int64), (code % k).astype(np.int64)
        kept = self.discount2[np.minimum(c, DISCOUNTED + 1)] * c
        kept = np.where(self.flat[h], c - 0.5, kept)
        return np.where(c > 0, np.log10(np.maximum(kept, 1e-300) / np.maximum(self.counts[h], 1)), self.alpha[h] + self.single[g])


def _classes(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places among the heads; len(heads) for the rest."""
    at = np.searchsorted(heads, hashes)
    hit = heads[np.minimum(at, len(heads) - 1)] == hashes if len(heads) else np.zeros(len(hashes), bool)
    return np.where(hit, at, len(heads))


def _pair_codes(text: str, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs of a text, start and end included, and the hashes of their second words, 0 for the end."""
    hashes = tokens(text)
    n = len(heads)
    g = np.append(_classes(hashes, heads), n + 1)
    h = np.append(n + 2, g[:-1])
    return (h * (n + 3) + g).astype(np.uint64), np.append(hashes, np.uint64(0))


def _wide_pairs(codes: np.ndarray, hashes: np.ndarray, n_heads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs with a word that is no head, in one or more texts, and the keys of their two words."""
    n, k = np.uint64(n_heads), np.uint64(n_heads + 3)
    h, g = codes // k, codes % k
    at = np.flatnonzero((h == n) | (g == n))
    h, g = h[at], g[at]
    # The word before is that of the place before; a text's first pair has the start there.
    return at, np.where(h == n, RARE | (hashes[at - 1] & LOW48), h), np.where(g == n, RARE | (hashes[at] & LOW48), g)


def _wide_block(h: np.ndarray, g: np.ndarray, n_heads: int, spread: np.ndarray, buckets: int) -> np.ndarray:
    """The block of the context of a wide pair; only heads are dealt to several."""
    rare = h >= RARE
    part = mixed(g) % spread[np.where(rare, np.uint64(n_heads), h).astype(np.int64)].astype(np.uint64)
    return bucket_of(mixed(np.where(rare, h, h * np.uint64(1 << 20) + part)), buckets)


def _wide_key(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """One hash for a wide pair."""
    return mixed(mixed(h) ^ (g * np.uint64(0x9E3779B97F4A7C15)))


def _counted_wide(h: np.ndarray, g: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, the sums of their counts, and a place of each."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))[: len(h)])
    return h[starts], g[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts, order[starts]


def _block_of(codes: np.ndarray, n_heads: int, spread: np.ndarray, buckets: int) -> np.ndarray:
    """A context's block; one of several, by continuation, for a context that holds much of the corpus."""
    k = np.uint64(n_heads + 3)
    h, g = codes // k, codes % k
    part = mixed(g) % spread[h.astype(np.int64)].astype(np.uint64)
    return bucket_of(mixed(h * np.uint64(1 << 20) + part), buckets)


BLOCK = "bucket int, kind int, block binary"
_BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])


def _row(bucket: int, kind: int, block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.binary())], schema=_BLOCK)


def _trained(doc_id: int | None) -> bool:
    return held_out_remainder(doc_id, 10) != 0


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, docs = 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            words, n = counted(np.concatenate(held))
            for b, at in by_bucket(bucket_of(words, buckets), buckets):
                yield _row(b, 0, pack(words[at], n[at]))

        for ids, texts in steps(batches):
            for doc_id, text in zip(ids, texts, strict=True):
                if _trained(doc_id):
                    held.append(tokens(text))
                    size, docs = size + len(held[-1]), docs + 1
            if size >= FLUSH:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()
        # How many texts were read, hence end tokens.
        yield _row(0, 1, pack(np.array([docs], np.uint64)))

    return run


#: kind 0: the counts of a block. 1: types with count a (up to 6; 7: more), in b, with the sum of their counts in c. 2: word a has count b. 3: a texts.
FOUND = "bucket int, kind int, a long, b long, c long, block binary"
_FOUND = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("block", pa.binary())])


def _found(bucket: int, kind: int, a, b, c, block: bytes | None = None) -> pa.Table:
    n = len(a)
    return pa.Table.from_arrays([pa.array(np.full(n, bucket, np.int32)), pa.array(np.full(n, kind, np.int32)), *[pa.array(np.asarray(x, np.int64)) for x in (a, b, c)], pa.array([block] * n, pa.binary())], schema=_FOUND)


def _sum_words(heads_each: int):
    def run(table: pa.Table) -> pa.Table:
        bucket, kinds = table.column("bucket")[0].as_py(), table.column("kind").to_pylist()
        parts = [unpack(x.as_py(), 2) for x, kind in zip(table.column("block"), kinds, strict=True) if kind == 0]
        docs = sum(int(unpack(x.as_py(), 1)[0][0]) for x, kind in zip(table.column("block"), kinds, strict=True) if kind == 1)
        words, n = counted(np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)]), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)]))
        kind = np.minimum(n, DISCOUNTED + 2)
        types, mass = np.bincount(kind, minlength=DISCOUNTED + 3), np.bincount(kind, n, DISCOUNTED + 3)
        top = np.lexsort((words, -n))[:heads_each]
        r = np.arange(1, DISCOUNTED + 3)
        return pa.concat_tables([
            _found(bucket, 0, [0], [0], [0], pack(words, n)), _found(bucket, 1, r, types[r], mass[r]),
            _found(bucket, 2, words[top].view(np.int64), n[top], np.zeros(len(top))), _found(bucket, 3, [docs], [0], [0]),
        ])

    return run


def _count_pairs(buckets: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, spread = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            """kind 0: pairs of heads. 1: wide pairs to the block of a second word that is no head. 2: other wide pairs to the block of the first."""
            codes, hashes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            wide, h, g = _wide_pairs(codes, hashes, len(heads))
            h, g, n, at = _counted_wide(h, g, np.ones(len(wide), np.int64))
            rare = g >= RARE
            to = np.where(rare, bucket_of(hashes[wide[at]], buckets), _wide_block(h, g, len(heads), spread, buckets))
            for kind, which in ((1, np.flatnonzero(rare)), (2, np.flatnonzero(~rare))):
                for b, at in by_bucket(to[which], buckets):
                    yield _row(b, kind, pack(h[which[at]], g[which[at]], n[which[at]]))
            plain = np.ones(len(codes), bool)
            plain[wide] = False
            codes, n = counted(codes[plain])
            for b, at in by_bucket(_block_of(codes, len(heads), spread, buckets), buckets):
                yield _row(b, 0, pack(codes[at], n[at]))

        for ids, texts in steps(batches):
            for doc_id, text in zip(ids, texts, strict=True):
                if _trained(doc_id):
                    held.append(_pair_codes(text, heads))
                    size += len(held[-1][0])
            if size >= FLUSH:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return run


#: kind 0: the pair counts of a block. 1: context a's types by count 1 to 6, in n1 to n6; b: the sum of its counts beyond 5; p: the P(g) of all it was seen with. 2: pair a has count b.
#: 3: wide pairs for a block, with the single counts of second words that are no heads. 4: the wide pairs of a block. 5: types of its contexts that are no heads, by count 1 to 6.
FEW = [f"n{r}" for r in range(1, DISCOUNTED + 2)]
PAIRS = f"bucket int, kind int, a long, b long, p double, {', '.join(f'{x} int' for x in FEW)}, block binary"
_PAIRS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("p", pa.float64()), *[(x, pa.int32()) for x in FEW], ("block", pa.binary())])


def _pair_rows(bucket: int, kind: int, a, b=None, p=None, few=None, block: bytes | None = None) -> pa.Table:
    n = len(a)
    few = np.zeros((n, DISCOUNTED + 1)) if few is None else few
    return pa.Table.from_arrays([
        pa.array(np.full(n, bucket, np.int32)), pa.array(np.full(n, kind, np.int32)),
        *[pa.array(np.zeros(n, t) if x is None else np.asarray(x, t)) for x, t in ((a, np.int64), (b, np.int64), (p, np.float64))],
        *[pa.array(np.ascontiguousarray(few[:, i]).astype(np.int32)) for i in range(DISCOUNTED + 1)], pa.array([block] * n, pa.binary()),
    ], schema=_PAIRS)


def _by_context(h: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs sorted by context: the contexts, their types by count 1 to 6, the sums of their counts beyond 5, and of p."""
    if not len(h):
        return h, np.zeros((0, DISCOUNTED + 1)), np.zeros(0), np.zeros(0)
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    few = np.stack([np.add.reduceat((n == r).astype(np.int32), starts) for r in range(1, DISCOUNTED + 2)], axis=1)
    return h[starts], few, np.add.reduceat(np.where(n > DISCOUNTED, n, 0), starts), np.add.reduceat(p, starts)


def _sum_pairs(pairs_each: int, buckets: int, shared):
    def run(table: pa.Table, singles: pa.Table) -> pa.Table:
        n_heads, p1, spread = shared.value
        if not table.num_rows:
            return pa.Table.from_batches([], _PAIRS)
        bucket = table.column("bucket")[0].as_py()
        rows = list(zip(table.column("kind").to_pylist(), table.column("block"), strict=True))

        def of(kind: int, columns: int) -> list[np.ndarray]:
            parts = [unpack(x.as_py(), columns) for k, x in rows if k == kind]
            return [np.concatenate([np.zeros(0, np.uint64 if i == 0 else np.int64), *[p[i] for p in parts]]) for i in range(columns)]

        codes, n = counted(*of(0, 2))
        h, g = np.divmod(codes, np.uint64(n_heads + 3))
        contexts, few, beyond, mass = _by_context(h, n, p1[g.astype(np.int64)])
        top = np.lexsort((codes, -n))[:pairs_each]
        out = [_pair_rows(bucket, 0, [0], block=pack(codes, n)), _pair_rows(bucket, 1, contexts, beyond, mass, few), _pair_rows(bucket, 2, codes[top].astype(np.int64), n[top])]

        h, g, n = of(1, 3)
        if len(h):
            h, g, n, _ = _counted_wide(h, g.view(np.uint64), n)
            c = _counts_of(g & LOW48, *_by_low_bits([unpack(x.as_py(), 2) for x in singles.column("block")]))
            for b, at in by_bucket(_wide_block(h, g, n_heads, spread, buckets), buckets):
                out.append(_pair_rows(b, 3, [0], block=pack(h[at], g[at], n[at], c[at])))
        h, g, n = of(2, 3)
        if len(h):
            h, g, n, _ = _counted_wide(h, g.view(np.uint64), n)
            out.append(_pair_rows(bucket, 3, [0], block=pack(h, g, n, np.zeros(len(h)))))
        return pa.concat_tables(out)

    return run


def _by_low_bits(blocks: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block by the low bits of their hashes, and their counts."""
    words = np.concatenate([np.zeros(0, np.uint64), *[b[0] for b in blocks]]) & LOW48
    counts = np.concatenate([np.zeros(0, np.int64), *[b[1] for b in blocks]])
    order = np.argsort(words, kind="stable")
    return words[order], counts[order]


def _counts_of(values: np.ndarray, have: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(have, values), max(0, len(have) - 1))
    return np.where(have[at] == values, n[at], 0) if len(have) else np.zeros(len(values), np.int64)


def _single_p(g: np.ndarray, c: np.ndarray, p1: np.ndarray, discount1: np.ndarray, total: int) -> np.ndarray:
    """P of second words of wide pairs; c are the single counts of those that are no heads."""
    rare = g >= RARE
    return np.where(rare, discount1[np.minimum(c, DISCOUNTED + 1)] * c / max(1, total), p1[np.where(rare, np.uint64(0), g).astype(np.int64)])


def _sum_wide(shared):
    """The wide pairs of a block, each of which comes once, and what they add to the sums of contexts."""

    def run(table: pa.Table) -> pa.Table:
        p1, discount1, total = shared.value
        bucket = table.column("bucket")[0].as_py()
        h, g, n, c = (np.concatenate(x) for x in zip(*[unpack(x.as_py(), 4) for x in table.column("block")], strict=True))
        order = np.lexsort((g, h))
        h, g, n, c = h[order], g[order].view(np.uint64), n[order], c[order]
        contexts, few, beyond, mass = _by_context(h, n, _single_p(g, c, p1, discount1, total))
        head = contexts < RARE
        return pa.concat_tables([
            _pair_rows(bucket, 4, [0], block=pack(h, g, n, c)), _pair_rows(bucket, 1, contexts[head], beyond[head], mass[head], few[head]),
            _pair_rows(bucket, 5, [0], few=few[~head].sum(0, keepdims=True)),
        ])

    return run


def fit(docs: DataFrame, heads: int = HEADS) -> Model:
    """Counts of all rows (doc_id, text) whose id is not held out."""
    spark = docs.sparkSession
    buckets = shuffle_buckets(spark)
    each = max(1, heads // buckets)
    share = spark.sparkContext.broadcast
    words = written(docs.mapInArrow(_count_words(buckets), BLOCK).groupBy("bucket").applyInArrow(_sum_words(each), FOUND), "kind")
    # Seven rows, then at most `heads`.
    sums = {r["a"]: (r["b"], r["c"]) for r in words.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("b"), F.sum("c").alias("c")).collect()}
    n_docs = words.filter("kind = 3").agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
    top = words.filter("kind = 2").select("a", "b").toArrow()
    hashes, counts = top["a"].to_numpy().view(np.uint64), top["b"].to_numpy()
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]

    total = sum(c for _, c in sums.values()) + n_docs
    types = sum(b for b, _ in sums.values()) + (n_docs > 0)
    d1 = good_turing({r: b for r, (b, _) in sums.items()})
    factor = d1[np.minimum(np.arange(DISCOUNTED + 3), DISCOUNTED + 1)]
    end_factor = factor[min(n_docs, DISCOUNTED + 1)] if n_docs else 0.0
    kept = sum(factor[r] * c for r, (_, c) in sums.items()) + end_factor * n_docs
    if total and kept > total - 0.5:
        # Nothing was rare enough to be discounted: the smallest share goes to the unknown all the same.
        d1 = d1 * (total - 0.5) / kept
        factor = d1[np.minimum(np.arange(DISCOUNTED + 3), DISCOUNTED + 1)]
        end_factor, kept = (factor[min(n_docs, DISCOUNTED + 1)] if n_docs else 0.0), total - 0.5
    p0 = 1 - kept / total if total else 1.0
    head_p = d1[np.minimum(counts, DISCOUNTED + 1)] * counts / max(1, total)
    end_p = end_factor * n_docs / max(1, total)
    if not total:
        end_p = 1.0
    p1 = np.concatenate([head_p, [max(1 - head_p.sum() - end_p, p0)], [end_p], [0.0]])
    rare = total - n_docs - int(counts.sum())
    contexts = np.concatenate([counts, [rare], [0], [n_docs]])
    # Contexts that would fill a good part of a block by themselves are dealt to several.
    spread = np.minimum(1 + contexts * 4 * buckets // max(1, total), 4 * buckets).astype(np.int64)

    pair_rows = docs.mapInArrow(_count_pairs(buckets, share((hashes, spread))), BLOCK)
    singles = words.filter("kind = 0").select("bucket", "block")
    pairs = written(pair_rows.groupBy("bucket").cogroup(singles.groupBy("bucket")).applyInArrow(_sum_pairs(each, buckets, share((len(hashes), p1, spread))), PAIRS), "kind")
    wide = written(pairs.filter("kind = 3").groupBy("bucket").applyInArrow(_sum_wide(share((p1, d1, int(total)))), PAIRS), "kind")
    # A row for each head and block of its own: bounded by heads and blocks.
    seen = pairs.filter("kind = 1").unionByName(wide.filter("kind = 1")).select("a", "b", "p", *FEW).toArrow()
    few, beyond, mass = np.zeros((len(contexts), DISCOUNTED + 1)), np.zeros(len(contexts)), np.zeros(len(contexts))
    at = seen["a"].to_numpy()
    for i, x in enumerate(FEW):
        np.add.at(few[:, i], at, seen[x].to_numpy())
    np.add.at(beyond, at, seen["b"].to_numpy())
    np.add.at(mass, at, seen["p"].to_numpy())
    others = wide.filter("kind = 5").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in FEW]).first()
    d2 = good_turing({r: few[:, r - 1].sum() + others[r - 1] for r in range(1, DISCOUNTED + 2)})
    r = np.arange(1, DISCOUNTED + 1)
    kept2 = beyond + few[:, :DISCOUNTED] @ (d2[r] * r)
    # A context seen with large counts only keeps nothing for the unseen; it gives half a count of each pair.
    flat = (beyond > 0) & (few[:, :DISCOUNTED].sum(1) == 0)
    kept2 = np.where(flat, beyond, kept2)
    top = pairs.filter("kind = 2").select("a", "b").toArrow()
    codes, pair_counts = top["a"].to_numpy().astype(np.uint64), top["b"].to_numpy()
    order = np.argsort(codes)
    codes, pair_counts = codes[order], pair_counts[order]
    if flat.any():
        kinds = pairs.filter("kind = 0").unionByName(wide.filter("kind = 4"))
        kept2 = kept2 - 0.5 * _types_of(kinds, share((len(hashes), flat)), len(contexts))
    left, free = 1 - kept2 / np.maximum(contexts, 1), 1 - mass
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(contexts > 0, np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(free, 1e-12)), 0.0)
        single = np.log10(np.maximum(p1, 1e-300))
    alpha[len(hashes) + 1] = 0.0
    model = Model(buckets, int(total), int(types), hashes, contexts, single, alpha, d1, d2, flat, float(np.log10(p0)), spread, codes, np.zeros(len(codes)), singles, pairs.filter("kind = 0").select("bucket", "block"), wide.filter("kind = 4").select("bucket", "block"))
    return model._replace(pair_logs=model.pair_log(codes, pair_counts))


def _types_of(tables: DataFrame, shared, n: int) -> np.ndarray:
    """Distinct continuations of the marked contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_heads, flat = shared.value
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("block"), strict=True):
                h = unpack(blob.as_py(), 4)[0] if kind == 4 else unpack(blob.as_py(), 2)[0] // np.uint64(n_heads + 3)
                h = h[h < RARE].astype(np.int64)
                h, each = np.unique(h[flat[h]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(each)], ["a", "n"])

    out = np.zeros(n)
    for r in tables.select("kind", "block").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        out[r["a"]] = r["n"]
    return out


def _look_up(shared):
    """Sends what needs a table to its block: kind 0 pairs, kind 1 words that are no heads and kind 4 wide pairs with their texts' places, kind 2 the texts themselves with what is known of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        n = len(m.frequent)
        base_of = m.base(m.counts[:n])
        end_base = m.base(m.counts[n + 2])
        part = TaskContext.get().partitionId() << 32
        seen, first = 0, 0
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(x[0]) for x in held])
            code, place = np.concatenate([x[0] for x in held]), np.repeat(np.arange(len(held)), lengths)
            words = np.concatenate([x[1] for x in held])
            g = (code % np.uint64(n + 3)).astype(np.int64)
            is_word = g != n + 1
            known = is_word & (g < n)
            ends = np.cumsum(lengths)
            total = lambda x: np.bincount(place, x, len(held))
            base = total(np.where(known, base_of[np.minimum(g, max(0, n - 1))] if n else 0.0, 0.0)) + end_base
            at = np.minimum(np.searchsorted(m.pairs, code), max(0, len(m.pairs) - 1))
            direct = m.pairs[at] == code if len(m.pairs) else np.zeros(len(code), bool)
            score = total(np.where(direct, m.pair_logs[at] if len(m.pairs) else 0.0, 0.0))
            n_known = total(known).astype(np.int64) + (m.counts[n + 2] > 0)
            uid = part + first + np.arange(len(held))
            start = first
            for b, at in by_bucket(_text_block(uid, m.buckets), m.buckets):
                ids = np.array([held[i][2] or 0 for i in at], np.int64)
                yield _row(b, 2, pack(uid[at].astype(np.uint64), ids, np.array([held[i][2] is not None for i in at]), lengths[at], n_known[at], np.rint(base[at] / UNIT), np.rint(score[at] / UNIT)))
            wide, h, g2 = _wide_pairs(code, words, n)
            direct[wide] = True
            rest = np.flatnonzero(~direct)
            rest = rest[np.argsort(code[rest], kind="stable")]
            for b, at in by_bucket(_block_of(code[rest], n, m.spread, m.buckets), m.buckets):
                yield _row(b, 0, pack(code[rest[at]], place[rest[at]]) + int(part + start).to_bytes(8, "little"))
            order = np.lexsort((g2, h))
            wide, h, g2 = place[wide[order]], h[order], g2[order]
            for b, at in by_bucket(_wide_block(h, g2, n, m.spread, m.buckets), m.buckets):
                yield _row(b, 4, pack(h[at], g2[at], wide[at]) + int(part + start).to_bytes(8, "little"))
            rare = np.flatnonzero(g == n)
            to = bucket_of(words[rare], m.buckets)
            rare = rare[np.lexsort((words[rare] & LOW48, to))]
            for b, at in by_bucket(bucket_of(words[rare], m.buckets), m.buckets):
                yield _row(b, 1, pack(words[rare[at]] & LOW48, place[rare[at]]) + int(part + start).to_bytes(8, "little"))
            assert ends[-1] == len(code)

        for ids, texts in steps(batches):
            for doc_id, text in zip(ids, texts, strict=True):
                held.append((*_pair_codes(text, m.frequent), doc_id))
                size, seen = size + len(held[-1][0]), seen + 1
            if size >= FLUSH:
                yield from out()
                held, size, first = [], 0, seen
        if held:
            yield from out()

    return run


def _text_block(uid: np.ndarray, buckets: int) -> np.ndarray:
    """Texts go in runs, so that their numbers pack well."""
    return bucket_of(mixed((uid >> 9).astype(np.uint64)), buckets)


class Wide:
    """The wide pairs of a block, and what its contexts that are no heads leave."""

    def __init__(self, m: Model, h: np.ndarray, g: np.ndarray, n: np.ndarray, c: np.ndarray) -> None:
        self.model, g = m, g.view(np.uint64)
        keys = _wide_key(h, g)
        order = np.argsort(keys)
        self.keys, self.n, self.c = keys[order], n[order], c[order]
        p1 = 10.0**m.single
        rare = h >= RARE
        h, g, n, c = h[rare], g[rare], n[rare], c[rare]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        self.contexts = h[starts]
        if len(starts):
            self.counts, self.flat = np.add.reduceat(n, starts), np.minimum.reduceat(n, starts) > DISCOUNTED
            kept = np.where(np.repeat(self.flat, np.diff(np.append(starts, len(n)))), n - 0.5, m.discount2[np.minimum(n, DISCOUNTED + 1)] * n)
            left, free = 1 - np.add.reduceat(kept, starts) / self.counts, 1 - np.add.reduceat(_single_p(g, c, p1, m.discount1, m.train_tokens), starts)
            self.alpha = np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(free, 1e-12))

    def logs(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """log10 P(g | h), less log10 P(g) where g is no head: its own block adds that."""
        m = self.model
        keys, rare, other = _wide_key(h, g), h >= RARE, g >= RARE
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        n, c = (np.where(self.keys[at] == keys, x[at], 0) if len(self.keys) else np.zeros(len(keys), np.int64) for x in (self.n, self.c))
        place = np.where(rare, np.uint64(len(m.frequent)), h).astype(np.int64)
        counts, flat, alpha = m.counts[place], m.flat[place], np.where(rare, 0.0, m.alpha[place])
        if len(self.contexts):
            k = np.minimum(np.searchsorted(self.contexts, h), len(self.contexts) - 1)
            known = rare & (self.contexts[k] == h)
            counts, flat, alpha = np.where(known, self.counts[k], counts), np.where(known, self.flat[k], flat), np.where(known, self.alpha[k], alpha)
        kept = np.where(flat, n - 0.5, m.discount2[np.minimum(n, DISCOUNTED + 1)] * n)
        seen = np.log10(np.maximum(kept, 1e-300) / np.maximum(counts, 1)) - np.where(other, m.rare_log(c), 0.0)
        return np.where(n > 0, seen, alpha + np.where(other, 0.0, m.single[np.where(other, np.uint64(0), g).astype(np.int64)]))


def _answer(shared):
    """Per block: what its pairs and its words that are no heads add to each text."""

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        m: Model = shared.value
        if not asked.num_rows:
            return pa.Table.from_batches([], _BLOCK)
        uids, known, base, score = [], [], [], []
        rows = list(zip(asked.column("kind").to_pylist(), asked.column("block"), strict=True))
        passed = [(2, blob.as_py()) for kind, blob in rows if kind == 2]
        stored = {kind: unpack(blob.as_py(), 4 if kind == 4 else 2) for kind, blob in zip(table.column("kind").to_pylist(), table.column("block"), strict=True)}
        empty = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        words, word_counts = _by_low_bits([stored.get(1, empty)])
        wide = Wide(m, *stored.get(4, [*empty, *empty[1:], *empty[1:]]))
        for kind, blob in rows:
            if kind == 2:
                continue
            raw = blob.as_py()
            value, *g, place = unpack(raw[:-8], 3 if kind == 4 else 2)
            first = int.from_bytes(raw[-8:], "little")
            c = _counts_of(value, *((words, word_counts) if kind == 1 else stored.get(0, empty)))
            here, back = np.unique(place, return_inverse=True)
            total = lambda x: np.bincount(back, x, len(here))  # noqa: B023, E731
            uids.append(first + here)
            if kind == 1:
                known.append(total(c > 0))
                base.append(total(m.base(c)))
                score.append(total(m.rare_log(c)))
            else:
                known.append(np.zeros(len(here)))
                base.append(np.zeros(len(here)))
                score.append(total(wide.logs(value, g[0].view(np.uint64)) if kind == 4 else m.pair_log(value, c)))
        out = []
        bucket = asked.column("bucket")[0].as_py()
        if uids:
            uid, at = np.unique(np.concatenate(uids), return_inverse=True)
            whole = [np.bincount(at, np.concatenate(x), len(uid)) for x in (known, base, score)]
            for b, k in by_bucket(_text_block(uid, m.buckets), m.buckets):
                out.append(_row(b, 3, pack(uid[k].astype(np.uint64), whole[0][k], np.rint(whole[1][k] / UNIT), np.rint(whole[2][k] / UNIT))))
        # Texts are in their own block already.
        out += [_row(bucket, kind, blob) for kind, blob in passed]
        return pa.Table.from_batches(out, _BLOCK)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _total(train_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("kind").to_pylist(), table.column("block"), strict=True))
        texts = [np.concatenate(x) for x in zip(*[unpack(b.as_py(), 7) for kind, b in rows if kind == 2], strict=True)]
        parts = [np.concatenate(x) for x in zip(*[unpack(b.as_py(), 4) for kind, b in rows if kind == 3], strict=True)]
        order = np.argsort(texts[0])
        uid, doc_id, there, n, known, base, score = (x[order] for x in texts)
        if parts:
            at = np.searchsorted(uid, parts[0])
            for whole, part in zip((known, base, score), parts[1:], strict=True):
                np.add.at(whole, at, part)
        ids = [int(i) if t else None for i, t in zip(doc_id, there, strict=True)]
        held = [held_out_remainder(i, 10) == 0 for i in ids]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n), pa.array(known), pa.array(np.full(len(n), train_tokens, np.int64)), pa.array(base * UNIT), pa.array(score * UNIT)], [x.split()[0] for x in SCORES.split(", ")])

    return run


def evaluate(docs: DataFrame, model: Model) -> DataFrame:
    """The model's and the base log10 probabilities of every row (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model._replace(unigrams=None, bigrams=None, wide=None))
    asked = docs.mapInArrow(_look_up(shared), BLOCK)
    tables = [t.select("bucket", F.lit(kind).alias("kind"), "block") for kind, t in ((0, model.bigrams), (1, model.unigrams), (4, model.wide))]
    tables = tables[0].union(tables[1]).union(tables[2])
    answers = asked.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(_answer(shared), BLOCK)
    return answers.groupBy("bucket").applyInArrow(_total(model.train_tokens), SCORES)


def _steady(docs: DataFrame) -> DataFrame:
    """docs as they are if they are plainly scanned, else written: texts are numbered by their place, which a task that runs again must find as it was."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    plain = all(node.lstrip(" +-:").startswith(("Project", "Filter", "Relation", "LocalRelation", "LogicalRDD")) for node in plan.splitlines())
    return docs if plain else written(docs)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The model's and the base log10 probabilities of every row."""
    docs = _steady(id_and_text(docs, id_col, text_col))
    return evaluate(docs, fit(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
