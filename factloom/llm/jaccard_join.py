"""Exact n-gram Jaccard join by PartEnum signatures.

Sets are banded by size, a band ending at 16/9 of its start, so that two sets alike by 3/4 lie in the same band or in
neighbouring ones. A set takes part in the scheme of its own band and, if a smaller partner can lie in the band
below, in that one. A scheme that must bear k differences splits the shingle domain into n1 parts of `second` pieces each;
a signature is a part's content on a subset of second - bear of its pieces. Differences that leave no subset untouched in
any part number more than k, so two sets that are alike enough share a signature, unless what they share is empty.

That last case, and signatures that very many sets share (a passage in many documents), are settled by counting: a set whose
usable signatures outnumber the differences it may have finds all its partners without the rest. Pairs of sets for which
this fails meet by prefix filtering among themselves, rarest shingles first. So hot signatures are left aside without losing a pair.

Every candidate is verified on the sets. In a group that shares a signature, all are first held against its least member; only
pairs that the links found so far don't connect are then compared one by one. Exact copies count as one set.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer words than the width make one
shingle; null ids are kept as rows of their own and never become a component's id while it has another; repeated rows
each get a row; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import attach, bucket_of, by_bucket, documents, frugal, mixed, shingle_hashes, shuffle_buckets, steps, word_hashes, words_of
from factloom.llm.components import components
from factloom.session import written

WIDTH = 5
#: Pieces of a part of the domain, and how many of them may differ.
SECOND, BEAR = 3, 2
#: Parts beyond the least number, for pieces that happen to be empty.
SPARE = 1.2
#: Sets that share a signature before it counts as hot.
HOT = 16
#: Common shingles that are known by name where sets meet by prefixes.
COMMON = 1 << 16
#: Sets of a group that are compared with each other at once.
BLOCK = 1024
#: Counts in the outline of a set.
CELLS = 64
#: Rows of 8 bytes that are sent to all workers rather than shuffled.
FEW = 1 << 20
#: Packed signatures that a worker gathers before it hands them on.
FLUSH = 1_000_000


@functools.cache
def band(size: int) -> tuple[int, int]:
    """(number, last size) of the band that holds `size`."""
    number, last = 0, 1
    while last < size:
        number, last = number + 1, (last + 1) * 16 // 9
    return number, last


def differences(size: int, larger: int) -> int:
    """Most elements that differ between sets alike by 3/4, of these sizes or smaller: the common part is 3/7 of both sizes together."""
    return (size + larger) // 7


@functools.cache
def scheme(size: int) -> tuple[int, int]:
    """(parts, bear) for the band of `size`, which holds the smaller set of a pair."""
    last = band(size)[1]
    k = differences(last, last * 4 // 3)
    bear = min(BEAR, k)
    return 1 if not k else int((k // (bear + 1) + 1) * SPARE + 1), bear


@functools.cache
def roles(size: int) -> list[tuple[int, int, int, int]]:
    """(band, parts, bear, differences that a set of this size may have there) for its own band and perhaps the one below."""
    number, last = band(size)
    out = [(number, *scheme(size), differences(size, size * 4 // 3))]
    below = _start(number) - 1
    if number and size <= below * 4 // 3:
        out.append((number - 1, *scheme(below), differences(size, below)))
    return out


@functools.cache
def _start(number: int) -> int:
    first, last = 1, 1
    for _ in range(number):
        first, last = last + 1, (last + 1) * 16 // 9
    return first


def signatures(hashes: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each role of a set of distinct hashes: its signatures that aren't empty, and by how much they outnumber the differences it may have."""
    out = []
    for number, parts, bear, k in roles(len(hashes)):
        pieces = SECOND if parts > 1 else 1
        spread = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * number) >> np.uint64(32)
        cell = spread * np.uint64(parts * pieces) >> np.uint64(32)
        order = np.argsort(cell)
        cell = cell[order]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        cells, content = cell[starts], np.add.reduceat(mixed(hashes[order] + np.uint64(number)), starts)
        take = pieces - bear if pieces > 1 else 1
        if take == 1:
            # Subsets of one piece: each filled piece is a signature.
            found, room = mixed(content + mixed(cells * np.uint64(4096) + np.uint64(number))), len(cells) - k
        else:
            found, room = _subsets(cells.astype(np.int64), content, parts, pieces, take, number), 0
            room = int(np.minimum(np.bincount(cells.astype(np.int64) // pieces, minlength=parts), bear + 1).sum()) - k
        out.append((found, room))
    return out


def _subsets(cells: np.ndarray, content: np.ndarray, parts: int, pieces: int, take: int, number: int) -> np.ndarray:
    """Signatures of every subset of `take` pieces of every part that isn't empty."""
    whole, filled = np.zeros(parts * pieces, np.uint64), np.zeros(parts * pieces, bool)
    whole[cells], filled[cells] = content, True
    whole, filled, found = whole.reshape(parts, pieces), filled.reshape(parts, pieces), []
    for j, subset in enumerate(itertools.combinations(range(pieces), take)):
        sums = np.zeros(parts, np.uint64)
        for x in subset:
            sums = mixed(sums + whole[:, x])
        there = filled[:, subset].any(axis=1)
        where = np.arange(parts, dtype=np.uint64)[there] * np.uint64(64) + np.uint64(j)
        found.append(mixed(sums[there] + mixed(where * np.uint64(4096) + np.uint64(number))))
    return np.concatenate(found)


def outline(hashes: np.ndarray) -> np.ndarray:
    """How many elements each of CELLS parts of the domain holds, up to 255: outlines differ by no more than the sets do."""
    return np.minimum(np.bincount((hashes >> np.uint64(32)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8)


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words_of(text)), width))


def digest(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a whole set."""
    total = mixed(hashes).sum(dtype=np.uint64) if len(hashes) else np.uint64(0)
    return int(mixed(np.array([total + np.uint64(len(hashes))], np.uint64)).astype(np.int64)[0])


DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("row", "<i8"), ("key", "<i8"), ("size", "<i4")])
KEY = np.dtype([("key", "<i8"), ("doc_id", "<i8"), ("known", "u1"), ("row", "<i8"), ("size", "<i4"), ("room", "<i4"), ("outline", "u1", CELLS)])


class Blocks:
    """What a worker gathers, packed by bucket: documents, distinct sets, keys once, then for each signature 5 bytes and its key's place."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self._clear()

    def _clear(self) -> None:
        self.docs, self.sets, self.places, self.parts, self.n = [], [], {}, [], 0

    def add(self, doc_id: int | None, row: int, hashes: np.ndarray) -> None:
        key = digest(hashes) if len(hashes) else 0
        known = doc_id is not None
        self.docs.append((doc_id if known else 0, known, row, key, len(hashes)))
        if not len(hashes):
            return
        first = (not known, doc_id if known else 0, row)
        if (at := self.places.get(key)) is not None:
            # A copy only counts with its id.
            _, old_id, old_known, old_row, *rest = self.sets[at]
            if first < (not old_known, old_id, old_row):
                self.sets[at] = (key, first[1], known, row, *rest)
            return
        found = signatures(hashes)
        for role, (sigs, _) in enumerate(found):
            self.parts.append((sigs, np.full(len(sigs), len(self.sets) * 2 + role, np.uint32)))
            self.n += len(sigs)
        self.places[key] = len(self.sets)
        self.sets.append((key, first[1], known, row, len(hashes), min(room for _, room in found), outline(hashes)))

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.docs:
            return
        docs, sets = np.array(self.docs, DOC), np.array(self.sets, KEY)
        keys = sets["key"]
        sigs, places = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        # Of a signature that is hot already, one more than makes it hot are enough, and the others are counted.
        order = np.lexsort((keys[places >> 1], sigs))
        sigs, places = sigs[order], places[order]
        starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))[: len(sigs)]
        rank = np.arange(len(sigs)) - np.repeat(starts, np.diff(np.append(starts, len(sigs))))
        lost, sigs, places = places[rank > HOT], sigs[rank <= HOT], places[rank <= HOT]
        by_key = bucket_of(mixed(keys.view(np.uint64)), self.buckets)
        cut = lambda to: (o := np.argsort(to, kind="stable"), np.searchsorted(to[o], np.arange(self.buckets + 1)))
        (own, own_at), (gone, gone_at), (of_key, key_at) = cut(bucket_of(sigs, self.buckets)), cut(by_key[lost >> 1]), cut(by_key)
        doc, doc_at = cut(bucket_of(mixed(docs["doc_id"].astype("<i8").view(np.uint64) ^ np.uint64(77)), self.buckets))
        for b in range(self.buckets):
            mine, away = own[own_at[b] : own_at[b + 1]], lost[gone[gone_at[b] : gone_at[b + 1]]]
            d, k = docs[doc[doc_at[b] : doc_at[b + 1]]], sets[of_key[key_at[b] : key_at[b + 1]]]
            if not (len(mine) or len(away) or len(d) or len(k)):
                continue
            here, back = np.unique(np.concatenate([places[mine], away]) >> 1, return_inverse=True)
            back = (back * 2 + (np.concatenate([places[mine], away]) & 1)).astype("<u2" if len(here) < 32768 else "<u4")
            low = np.ascontiguousarray((sigs[mine] & np.uint64(0xFFFFFFFFFF)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
            yield b, struct.pack("<IIIII", len(here), len(mine), len(away), len(d), len(k)) + keys[here].astype("<i8").tobytes() + low.tobytes() + back.tobytes() + d.tobytes() + k.tobytes()
        self._clear()


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """Signatures, their keys and roles, then the keys and roles of what was only counted, documents and sets."""
    n_keys, n, n_lost, n_docs, n_sets = struct.unpack_from("<IIIII", blob)
    keys, at = np.frombuffer(blob, "<i8", n_keys, 20), 20 + 8 * n_keys
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, at).reshape(n, 5)
    kind = np.dtype("<u2" if n_keys < 32768 else "<u4")
    back = np.frombuffer(blob, kind, n + n_lost, at + 5 * n).astype(np.int64)
    at += 5 * n + kind.itemsize * (n + n_lost)
    key, role = keys[back >> 1], (back & 1).astype(np.int8)
    docs, sets = np.frombuffer(blob, DOC, n_docs, at), np.frombuffer(blob, KEY, n_sets, at + DOC.itemsize * n_docs)
    return wide.view("<u8").ravel(), key[:n], role[:n], key[n:], role[n:], docs, sets


BLOCKS = "bucket int, block binary"


def _blocks(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: Blocks) -> Iterator[pa.RecordBatch]:
            for x in b.flush():
                yield pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int32()), pa.array([x[1]], pa.binary())], ["bucket", "block"])

        blocks = Blocks(buckets)
        for ids, texts in steps(batches, "row"):
            for (doc_id, row), text in zip(ids, texts, strict=True):
                blocks.add(doc_id, row, shingle_set(text, width))
            if blocks.n >= FLUSH:
                yield from out(blocks)
        yield from out(blocks)

    return run


#: kind 0: sets a and b share n signatures, a being the least of those that do. kind 1: set b is in the group a. kind 2: n hot signatures of set a in role b.
#: kind 3: document b, in the row `row`, has the set a of n shingles. kind 4: set a of n shingles, first found in document b and its row, with room and outline.
MET = "kind int, a long, b long, n long, room int, row long, outline binary"


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs, without copying the pairs into records."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return a[starts], b[starts], np.diff(np.append(starts, len(a)))


def _meet(table: pa.Table) -> pa.Table:
    """What the sets of a bucket have in common; documents and sets are passed on."""
    frugal()
    sigs, keys, role, lost, lost_role, docs, sets = (np.concatenate(x) for x in zip(*[_unpack(x.as_py()) for x in table.column("block")], strict=True))
    order = np.lexsort((keys, sigs))
    sigs, keys, role = sigs[order], keys[order], role[order]
    fresh = np.append(True, (sigs[1:] != sigs[:-1]) | (keys[1:] != keys[:-1]))[: len(sigs)]
    sigs, keys, role = sigs[fresh], keys[fresh], role[fresh]
    starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1])[: len(sigs)])
    many = np.diff(np.append(starts, len(sigs)))
    each = np.repeat(many, many)
    hot = each > HOT
    rows: list[tuple] = []
    hot_keys, hot_roles = np.concatenate([keys[hot], lost]), np.concatenate([role[hot], lost_role])
    if len(hot_keys):
        rows.append((2, *_distinct(hot_keys, hot_roles.astype(np.int64))))
    first = np.repeat(keys[starts], many) if len(keys) else keys
    star = ~hot & (each > 1) & (keys != first)
    if star.any():
        rows.append((0, *_distinct(first[star], keys[star])))
    group = ~hot & (each > 2)
    if group.any():
        # Groups with the same members are one.
        name = np.repeat(mixed(np.add.reduceat(mixed(keys.view(np.uint64)), starts)), many).view(np.int64)
        rows.append((1, *_distinct(name[group], keys[group])))
    rows.append((3, docs["key"], docs["doc_id"], docs["size"]))
    sets = sets[np.lexsort((sets["row"], sets["doc_id"], 1 - sets["known"].astype(np.int8), sets["key"]))]
    sets = sets[np.append(True, sets["key"][1:] != sets["key"][:-1])[: len(sets)]]
    rows.append((4, sets["key"], sets["doc_id"], sets["size"]))
    total = sum(len(r[1]) for r in rows) - len(sets)
    columns = [pa.array(np.concatenate([np.full(len(r[1]), r[0], np.int32) for r in rows]))]
    unknown = np.concatenate([np.zeros(sum(len(r[1]) for r in rows[:-2]), bool), docs["known"] == 0, sets["known"] == 0])
    columns += [pa.array(np.concatenate([np.asarray(r[1], np.int64) for r in rows]))]
    columns += [pa.array(np.concatenate([np.asarray(r[2], np.int64) for r in rows]), mask=unknown)]
    columns += [pa.array(np.concatenate([np.asarray(r[3], np.int64) for r in rows]))]
    columns += [pa.array(np.concatenate([np.zeros(total, np.int32), sets["room"]]), mask=np.arange(total + len(sets)) < total)]
    plain = total - len(docs)
    columns += [pa.array(np.concatenate([np.zeros(plain, np.int64), docs["row"], sets["row"]]), mask=np.arange(total + len(sets)) < plain)]
    columns += [pa.array([None] * total + [x.tobytes() for x in sets["outline"]], pa.binary())]
    return pa.table(columns, names=["kind", "a", "b", "n", "room", "row", "outline"])


SETS = "key long, size long, hashes binary"


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in steps(batches):
            sets = [shingle_set(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["key", "size", "hashes"])

    return run


def _elements(buckets: int):
    """All shingles of all sets with their keys, packed by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            s, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            for b, at in by_bucket(bucket_of(mixed(s), buckets), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([s[at].tobytes() + keys[at].tobytes()], pa.binary())], ["bucket", "block"])

        n = 0
        for batch in batches:
            for key, blob in zip(batch.column("key").to_pylist(), batch.column("hashes"), strict=True):
                s = np.frombuffer(blob.as_buffer(), "<u8")
                held.append((s, np.full(len(s), key, np.int64)))
                n += len(s)
            if n >= FLUSH:
                yield from out()
                held, n = [], 0
        if held:
            yield from out()

    return run


#: kind 0: a block of keys and how many shingles each has for itself, by key; kind 1: shingle a is in b sets.
HELD = "kind int, bucket int, a long, b long, block binary"


def _held(buckets: int, each: int):
    def run(table: pa.Table) -> pa.Table:
        frugal()
        parts = [np.frombuffer(x.as_buffer(), np.uint64).reshape(2, -1) for x in table.column("block").combine_chunks()]
        s, keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).view(np.int64)
        order = np.lexsort((keys, s))
        s, keys = s[order], keys[order]
        fresh = np.append(True, (s[1:] != s[:-1]) | (keys[1:] != keys[:-1]))
        s, keys = s[fresh], keys[fresh]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        df = np.diff(np.append(starts, len(s)))
        own, n = np.unique(keys[starts[df == 1]], return_counts=True)
        blocks = [(b, own[at].tobytes() + n[at].astype(np.int64).tobytes()) for b, at in by_bucket(bucket_of(mixed(own.view(np.uint64)), buckets), buckets)]
        top = np.lexsort((s[starts], -df))[:each]
        top = top[df[top] > 2]
        k = len(blocks)
        kinds = np.repeat(np.array([0, 1], np.int32), [k, len(top)])
        columns = [kinds, np.concatenate([np.array([b for b, _ in blocks], np.int32), np.zeros(len(top), np.int32)]), np.concatenate([np.zeros(k, np.int64), s[starts[top]].view(np.int64)]), np.concatenate([np.zeros(k, np.int64), df[top]])]
        return pa.table([*map(pa.array, columns), pa.array([x for _, x in blocks] + [None] * len(top), pa.binary())], names=["kind", "bucket", "a", "b", "block"])

    return run


def _own(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for x in table.column("block").combine_chunks()]
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return pa.table([pa.array(keys), pa.array(np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64))], names=["key", "own"])


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(name, key) of the shingles, rarest first, of which two sets alike by 3/4 must share one, for each role of a set."""
        common, df = shared.value
        for batch in batches:
            for key, blob in zip(batch.column("key").to_pylist(), batch.column("hashes"), strict=True):
                s = np.frombuffer(blob.as_buffer(), "<u8")
                often = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    often = np.where(common[at] == s, df[at], 0)
                first = s[np.lexsort((s, often))[: len(s) // 4 + 1]]
                for number, *_ in roles(len(s)):
                    yield pa.RecordBatch.from_arrays([pa.array(mixed(first + np.uint64(number)).view(np.int64)), pa.array(np.full(len(first), key, np.int64))], ["name", "key"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs alike by 3/4, of joined rows with both sets."""
    frugal()
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("ha"), batch.column("hb"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and outlines don't rule out that they are alike by 3/4."""
    frugal()
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("ou", "ov"))
        a, b = (batch.column(c).to_numpy() for c in ("nu", "nv"))
        keep = (np.abs(x - y).sum(axis=1) * 7 <= a + b) & (4 * a >= 3 * b) & (4 * b >= 3 * a)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("u", "v", "n")], ["u", "v", "n"]).filter(pa.array(keep))


def fine_outline(hashes: np.ndarray) -> np.ndarray:
    """Counts like an outline's, of about half as many cells as elements; a finer one folds to a coarser one."""
    bits = max(6, int(len(hashes) // 2).bit_length())
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frugal()
    for batch in batches:
        fine = [fine_outline(np.frombuffer(x.as_buffer(), "<u8")).tobytes() for x in batch.column("hashes")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("size"), pa.array(fine, pa.binary())], ["key", "size", "fine"])


def _closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that fine outlines don't rule out."""
    frugal()
    for batch in batches:
        keep = []
        for a, b, n, m in zip(batch.column("fu"), batch.column("fv"), batch.column("nu").to_pylist(), batch.column("nv").to_pylist(), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint8).astype(np.int32), np.frombuffer(b.as_buffer(), np.uint8).astype(np.int32)
            cells = min(len(x), len(y))
            # A count of 255 may stand for more; such cells are left out.
            known = (x < 255).reshape(cells, -1).all(axis=1) & (y < 255).reshape(cells, -1).all(axis=1)
            apart = np.abs(x.reshape(cells, -1).sum(axis=1) - y.reshape(cells, -1).sum(axis=1))[known].sum()
            keep.append(int(apart) * 7 <= n + m)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("u", "v", "n")], ["u", "v", "n"]).filter(pa.array(keep, pa.bool_()))


def _nearer(pairs: DataFrame, fine: DataFrame) -> DataFrame:
    """Of near pairs (u, v, n), those worth comparing set by set."""
    of = lambda x: fine.select(F.col("key").alias(x), F.col("fine").alias(f"f{x}"), F.col("size").alias(f"n{x}"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "n", "fu", "fv", "nu", "nv").mapInArrow(_closer, "u long, v long, n long")


def _near(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Of pairs (u, v, n) of keys, those worth fetching their sets for."""
    of = lambda x: keys.select(F.col("key").alias(x), F.col("outline").alias(f"o{x}"), F.col("size").alias(f"n{x}"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "n", "ou", "ov", "nu", "nv").mapInArrow(_close, "u long, v long, n long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (u, v) of keys, those that link."""
    sets = sets.join(pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct(), "key", "left_semi")
    of = lambda x: sets.select(F.col("key").alias(x), F.col("hashes").alias(f"h{x}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", F.col("hu").alias("ha"), F.col("hv").alias("hb"))
    return both.mapInArrow(_shared, "u long, v long")


MEMBERS = "slot int, name long, i int, j int, mine int, key long, root long, size int, own int, outline binary"


def _compare(table: pa.Table, buckets: int) -> pa.Table:
    """Of the groups of a slot, pairs of different components that neither sizes, own shingles nor outlines rule out, packed by bucket: the same pair may meet in many groups."""
    frugal()
    get = lambda c: table.column(c).to_numpy()
    name, i, j, mine, key, root = (get(c) for c in ("name", "i", "j", "mine", "key", "root"))
    size, own = get("size").astype(np.int64), get("own").astype(np.int64)
    shape = np.frombuffer(b"".join(table.column("outline").to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
    order = np.lexsort((mine, j, i, name))
    name, i, j, mine, key, root, size, own, shape = (x[order] for x in (name, i, j, mine, key, root, size, own, shape))
    starts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    us, vs, held = [], [], 0
    for a, b in zip(starts, np.append(starts[1:], len(name))):
        # Between two blocks, the first block's rows against the second's; within one, each against the rest.
        middle = a + int((mine[a:b] == i[a]).sum()) if i[a] != j[a] else b
        for k in range(a, middle):
            rest = slice(k + 1 if middle == b else middle, b)
            common = np.minimum(size[k] - own[k], size[rest] - own[rest])
            fit = (root[rest] != root[k]) & (common >= 3 * (own[k] + own[rest])) & (4 * size[rest] >= 3 * size[k]) & (4 * size[k] >= 3 * size[rest])
            at = np.flatnonzero(fit)
            if len(at):
                at = at[np.abs(shape[rest][at] - shape[k]).sum(axis=1) * 7 <= size[k] + size[rest][at]]
                others = key[rest][at]
                us.append(np.minimum(others, key[k]))
                vs.append(np.maximum(others, key[k]))
                held += len(others)
        if held > FLUSH:
            # The same pairs meet in many groups.
            u, v, _ = _distinct(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
    u, v, _ = _distinct(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs)))
    blocks = [(b, u[at].tobytes() + v[at].tobytes()) for b, at in by_bucket(bucket_of(mixed(u.view(np.uint64)), buckets), buckets)]
    return pa.table([pa.array([b for b, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], names=["bucket", "block"])


def _pairs(table: pa.Table) -> pa.Table:
    """The distinct pairs of a bucket."""
    frugal()
    parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for x in table.column("block").combine_chunks()]
    u, v, _ = _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return pa.table([pa.array(u), pa.array(v)], names=["u", "v"])


def _apart(groups: DataFrame, labels: DataFrame, keys: DataFrame, slots: int) -> DataFrame:
    """Near pairs (u, v) within a group (name, key, own) that the labels (node, root) leave in different components.

    What a set has for itself bounds how alike it can be to another: of both, at most the smaller rest is common, and both
    sets' own shingles come on top. Groups are compared in blocks of bounded size, so that no task holds a whole large one, and
    only pairs that pass are put out.
    """
    rooted = groups.join(labels, groups["key"] == labels["node"], "left").select("name", "key", "own", F.coalesce("root", "key").alias("root"))
    of = rooted.groupBy("name").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi")
    rows = rooted.join(of.select("name", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "name").join(keys.select("key", "size", "outline"), "key")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("name", F.least("mine", "_o").alias("i"), F.greatest("mine", "_o").alias("j"), "mine", "key", "root", F.col("size").cast("int"), F.col("own").cast("int"), "outline")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("name", "i", "j"), F.lit(slots)).cast("int")).select(*[c.split()[0] for c in MEMBERS.split(", ")])
    buckets = 4 + slots // 64
    packed = rows.groupBy("slot").applyInArrow(lambda table: _compare(table, buckets), BLOCKS)
    return packed.groupBy("bucket").applyInArrow(_pairs, "u long, v long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, row_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, key, component_id): documents whose shingle sets are alike by 3/4 are linked; `key` names equal sets.

    With row_col, a whole number that tells rows apart, also that of the row and `first_row`, that of its component's first one by id
    (null ids last) and row_col.
    """
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.lit(0)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    buckets = shuffle_buckets(spark, docs)
    blocks = docs.mapInArrow(_blocks(width, 2 * buckets), BLOCKS)
    docs = docs.drop("row")
    met = written(blocks.groupBy("bucket").applyInArrow(_meet, MET), "kind")
    groups = met.filter("kind = 1").select(F.col("a").alias("name"), F.col("b").alias("key"))
    keys = met.filter("kind = 4").select(F.col("a").alias("key"), F.col("b").alias("doc_id"), F.col("n").alias("size"), "room", "row", "outline")

    hot = met.filter("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n")).groupBy(F.col("a").alias("key")).agg(F.max("n").alias("n"))
    per = 1 if SECOND - BEAR == 1 else BEAR + 1
    weak = written(keys.join(hot, "key", "left").filter(F.col("room") - per * F.coalesce("n", F.lit(0)) <= 0).select("key"))
    stars = met.filter("kind = 0").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("n").alias("n"))
    near = written(_near(stars, keys))
    sets = _fetched(docs, keys, near.select(F.col("u").alias("key")).union(near.select("v")).union(weak).distinct(), width)

    # Sets that signatures alone can't vouch for meet by their prefixes, rarest shingles first. Any order finds all pairs; this one,
    # by the most common shingles of these sets, a table of bounded size, keeps what many share out of the prefixes.
    suspects = sets.join(weak, "key", "left_semi").select("key", "size", "hashes")
    held = suspects.select("key", "hashes").mapInArrow(_elements(buckets), BLOCKS)
    held = written(held.groupBy("bucket").applyInArrow(_held(buckets, max(1, COMMON // buckets)), HELD))
    # A set that has over a quarter of its shingles for itself is like no other.
    alone = held.filter("kind = 0").select("bucket", "block").groupBy("bucket").applyInArrow(_own, "key long, own long")
    suspects = suspects.join(written(alone), "key", "left").withColumn("own", F.coalesce("own", F.lit(0))).filter(4 * F.col("own") <= F.col("size"))
    shares = written(suspects.select("key", "size", "own"))
    suspects = suspects.select("key", "hashes")
    often = held.filter("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("df")).toArrow()
    common, df = often["shingle"].to_numpy().view(np.uint64), often["df"].to_numpy()
    order = np.argsort(common)
    short = written(suspects.mapInArrow(_prefixes(spark.sparkContext.broadcast((common[order], df[order]))), "name long, key long"))
    # The set with the least of its own is likely what the others were made from: it is held against all.
    short = short.join(shares, "key")
    least = short.groupBy("name").agg(F.min_by("key", F.struct(F.col("own") / F.col("size"), F.col("key"))).alias("u"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("name", "u")
    more = short.join(least, "name").filter("u <> key").select(F.least("u", "key").alias("u"), F.greatest("u", "key").alias("v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    fine = written(sets.mapInArrow(_fine, "key long, size long, fine binary"))
    near = written(_nearer(near.union(_near(more, keys)), fine).groupBy("u", "v").agg(F.sum("n").alias("n")))

    # First each set with the least member it shares most with; then what these links leave apart.
    ends = near.union(near.select("v", "u", "n"))
    best = ends.groupBy("v").agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    best = written(best.distinct())
    links = written(_verified(best, sets))
    labels = components(links)
    lu, lv = labels.select(F.col("node").alias("u"), F.col("root").alias("ru")), labels.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    rest = near.join(best, ["u", "v"], "left_anti").join(lu, "u", "left").join(lv, "v", "left").filter(F.coalesce("ru", "u") != F.coalesce("rv", "v"))
    met_again = groups.withColumn("own", F.lit(0)).union(short.select("name", "key", "own"))
    apart = written(_apart(met_again, labels, keys, 8 * buckets).withColumn("n", F.lit(1).cast("long")))
    lacking = apart.select(F.col("u").alias("key")).union(apart.select("v")).distinct().join(sets.select("key"), "key", "left_anti")
    extra = _fetched(docs, keys, lacking, width)
    fine = fine.union(extra.mapInArrow(_fine, "key long, size long, fine binary"))
    rest = written(rest.select("u", "v").union(_nearer(apart, fine).select("u", "v")).distinct().join(best, ["u", "v"], "left_anti"))
    sets = sets.unionByName(extra)
    labels = components(links.union(_verified(rest, sets)))

    # Only sets with links have a component to look up; one of very many sets is looked up without bringing them together.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    linked = written(labels.withColumnRenamed("node", "key").join(keys.select("key", first.alias("first")), "key"))
    roots = written(linked.groupBy("root").agg(F.min("first").alias("least")))
    least = attach(linked.select("key", "root"), roots, "root").select("key", "least")
    named = written(keys.select("key", first.alias("first")).join(least, "key", "left").select("key", F.coalesce("least", "first").alias("first")))
    rows = met.filter("kind = 3").select(F.col("b").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("a")).alias("key"), "row")
    out = attach(rows, named, "key", "left")
    alone = F.col("key").isNull()
    columns = ["doc_id", "n_shingles", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id")]
    if row_col:
        columns += ["row", F.when(alone, F.col("row")).otherwise(F.col("first.row")).alias("first_row")]
    return out.select(*columns)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, but one of each component stays: that of the least id, null ids last. Texts without words are in no component and stay.

    Rows are told apart by hashes of id and text; of rows that share both, one stays if they have words.
    """
    row = F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(text_col).isNull(), F.col(text_col).cast("string"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = {c: names[i] for i, c in reversed(list(enumerate(docs.columns)))}
    rows = docs.select("*", row.alias("row")).toDF(*names, "row")
    grouped = written(join(rows, place[id_col], place[text_col], row_col="row").filter("n_shingles > 0").select("row", "first_row"))
    gone = written(grouped.filter("row <> first_row").select("row").distinct())
    twice = written(grouped.filter("row = first_row").groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row"))
    kept = _without(rows, gone)
    if not twice.isEmpty():
        again = rows.join(twice, "row", "left_semi").dropDuplicates(["row"])
        kept = _without(kept, twice).unionByName(again)
    return kept.drop("row").toDF(*docs.columns)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows but for those named in the written table gone; its 8 bytes a row go to the texts while they are few, else both are shuffled."""
    return rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, "row", "left_anti")


def _fetched(docs: DataFrame, keys: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The sets (key, size, hashes) of the wanted keys, from one document each. The ids are written first, so that few of them travel to the texts and not the texts to them."""
    ids = written(keys.join(wanted, "key", "left_semi").select("doc_id"))
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    return written(texts.mapInArrow(_sets(width), SETS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
