import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_bins(rows, length):
    """Every sequence is filled without gaps and not beyond its length."""
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_ids_are_the_library_s():
    library = Tokenizer.from_file(PATH)
    encode = packing.tokenizer(PATH)
    random.seed(2)
    texts = ["", " ", "a\n\nb  c\t\td  x　y z   ", "I'm we'LL 12345 ½ ²³ ٣", "\x1c\x1d a\x85b\xa0", "é é ́a 𝔡", "x<|endoftext|>y", " " * 6000 + "a", "a" * 3000]
    texts += ["".join(chr(random.choice([random.randrange(1, 128), random.randrange(128, 0x300), random.randrange(0x300, 0xD7FF), random.randrange(0x10000, 0x1FFFF)])) for _ in range(80)) for _ in range(300)]
    for t in texts:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:40])


def test_odd_rows_and_ids(docs, odd):
    out = packing.pack(docs(*odd), PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted(((i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in odd), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in out), key=repr) == want
    assert all(r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) for r in out)
    assert check_bins(out, 2048) == 1
    assert packing.pack(docs(), PATH).count() == 0


def test_long_documents_are_cut_so_that_only_the_first_piece_is_short(docs):
    rows = [(i, "word " * n) for i, n in enumerate([10, 2047, 2048, 5000, 6143, 100])]
    out = packing.pack(docs(*rows), PATH).collect()
    by_doc = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_doc.values():
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert parts[0]["start"] == 0 and all(a["start"] + a["length"] == b["start"] for a, b in zip(parts, parts[1:]))
        assert all(r["length"] == 2048 for r in parts[1:])
    check_bins(out, 2048)


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once_and_waste_little(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(5.5 + seed / 2, 1, 20000).astype(int) + 1, 2048)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    slots = packing.plan(counts)
    places, load = {}, {}
    for s in slots:
        assert s.first == places.get(s.size, 0) and s.count % s.each == 0
        places[s.size] = s.first + s.count
        for k in range(s.count // s.each):
            load[s.sequence + k] = load.get(s.sequence + k, 0) + s.each * s.size
    assert places == counts and max(load.values()) <= 2048
    # No more bins than two in a thousand above the least that could hold all, and those a size over half needs.
    least = max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum()))
    assert len(load) <= least * 1.002 + 3


def test_two_that_fit_replace_the_smallest():
    # Greedy fills 60 + 30 and leaves 10; 30 gives way to 25 + 15.
    assert packing.plan({60: 1, 30: 1, 25: 1, 15: 1}, 100) == [packing.Slots(60, 0, 1, 1, 0, 0), packing.Slots(25, 0, 1, 1, 0, 60), packing.Slots(15, 0, 1, 1, 0, 85), packing.Slots(30, 0, 1, 1, 1, 0)]
    assert packing.plan({}) == []


def test_full_pieces_are_sequences_of_their_own(spark):
    rows = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate([2048] * 40 + [1000, 1048, 2047, 1])], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.place(rows).collect()
    assert len(out) == 44 and check_bins(out, 2048) == 42
