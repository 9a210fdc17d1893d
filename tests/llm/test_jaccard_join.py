import random
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import jaccard_join as j

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    out = []
    for g in groups.values():
        ids = [rows[k][0] for k in g if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), min(ids) if ids else None) for k in g]
    return sorted(out, key=repr)


def run(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.join(df).collect()), key=repr)


def family(random, n, size, edits):
    base = [f"w{random.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[random.randrange(len(w))] = f"e{random.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_odd_rows(docs, odd):
    assert run(docs(*odd)) == brute(odd)
    assert run(docs()) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_families_of_all_sizes_and_likenesses(docs, seed):
    random.seed(seed)
    texts = []
    for size in (1, 2, 4, 5, 6, 7, 9, 12, 20, 40, 90, 200, 600):
        for edits in (0, 1, 2, 3, 5):
            texts += family(random, 4, size, min(edits, size))
        texts += [t + " tail" * k for k, t in enumerate(family(random, 4, size, 0))]
    random.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(docs(*rows)) == brute(rows)


def test_a_passage_in_many_documents_and_a_large_family(docs):
    """Hot signatures: more sets share them than HOT, and most of some sets is the passage."""
    random.seed(5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"{' '.join(f'x{random.randrange(10**6)}' for _ in range(12))} {passage}" for _ in range(60)]
    texts += family(random, 80, 120, 2)
    rows = list(enumerate(texts))
    assert run(docs(*rows)) == brute(rows)


def test_chains_are_one_component(docs):
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(20)]
    assert run(docs(*rows)) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 30, 70, 150, 400, 900])
def test_alike_sets_share_a_signature_or_are_both_weak(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        gone, new = rng.integers(0, size // 7 + 1), rng.integers(0, size // 7 + 1)
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
            continue
        one, two = j.signatures(a), j.signatures(b)
        shared = len(np.intersect1d(np.concatenate([s for s, _ in one]), np.concatenate([s for s, _ in two])))
        assert shared or (min(r for _, r in one) <= 0 and min(r for _, r in two) <= 0)


@pytest.mark.parametrize(("second", "bear"), [(3, 1), (4, 2), (3, 2)])
def test_other_ways_to_divide_the_domain(monkeypatch, second, bear):
    monkeypatch.setattr(j, "SECOND", second)
    monkeypatch.setattr(j, "BEAR", bear)
    j.scheme.cache_clear()
    j.roles.cache_clear()
    try:
        test_alike_sets_share_a_signature_or_are_both_weak(150)
    finally:
        j.scheme.cache_clear()
        j.roles.cache_clear()


def test_outlines_never_rule_out_alike_sets():
    rng = np.random.default_rng(3)
    for size in (10, 100, 1000):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[size // 8 :], rng.integers(0, 2**64, size // 8, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert np.abs(j.outline(a).astype(int) - j.outline(b).astype(int)).sum() <= apart
        x, y = j.fine_outline(a).astype(int), j.fine_outline(b).astype(int)
        n = min(len(x), len(y))
        assert np.abs(x.reshape(n, -1).sum(1) - y.reshape(n, -1).sum(1)).sum() <= apart
