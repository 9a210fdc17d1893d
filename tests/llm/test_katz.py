import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import katz
from factloom.llm.common import id_and_text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def trained(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0


def brute(rows, heads, model):
    """Scores of rows by dictionaries; the heads, being chosen by hash, are taken from the model."""
    from factloom.llm.common import word_hashes

    single, pairs, context, n_docs = Counter(), Counter(), Counter(), 0
    known = set(model.heads.tolist())
    cls = lambda w: w if w in ("<end>", "<start>") or int(word_hashes([w.encode()])[0]) in known else "<rare>"
    for i, t in rows:
        if trained(i):
            w = split(t)
            n_docs += 1
            single.update(w)
            chain = ["<start>", *map(cls, w), "<end>"]
            pairs.update(zip(chain, chain[1:]))
            context.update(chain[:-1])
    total = sum(single.values()) + n_docs
    types = len(single) + (n_docs > 0)
    d1 = katz.good_turing(Counter(single.values()))
    d2 = katz.good_turing(Counter(pairs.values()))
    disc = lambda d, c: d[min(c, 6)] * c
    p = {w: disc(d1, c) / total for w, c in single.items()}
    p_end = disc(d1, n_docs) / total
    p0 = 1 - sum(p.values()) - p_end
    p_class = {w: p[w] for w in p if cls(w) == w} | {"<end>": p_end}
    p_class["<rare>"] = 1 - sum(p_class.values())
    seen = {}
    for (h, g), c in pairs.items():
        seen.setdefault(h, {})[g] = c
    flat = {h for h, gs in seen.items() if min(gs.values()) > 5}
    kept = lambda h, c: c - 0.5 if h in flat else disc(d2, c)

    def chance(h, g):
        if h not in seen:
            return p_class[g]
        if g in seen[h]:
            return kept(h, seen[h][g]) / context[h]
        left = 1 - sum(kept(h, c) for c in seen[h].values()) / context[h]
        return left / (1 - sum(p_class[x] for x in seen[h])) * p_class[g]

    sums = {h: sum(chance(h, g) for g in p_class) for h in [*seen, "<rare>"] if len(seen.get(h, {})) < len(p_class)}
    out = []
    for i, t in rows:
        w = split(t)
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (types + 1))) for c in [*(single[x] for x in w), n_docs])
        score, h = 0.0, "<start>"
        for x in [*w, "<end>"]:
            g = cls(x)
            score += math.log10(chance(h, g))
            if g == "<rare>":
                score += math.log10((p[x] if x in p else p0) / p_class["<rare>"])
            h = g
        out.append((i, len(w) + 1, sum(single[x] > 0 for x in w) + (n_docs > 0), total, base, score))
    return out, sums


def corpus(seed=7, n=250):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    return [(i, " ".join(random.choices(vocabulary, weights, k=random.randrange(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("heads", [16, 64, 100_000])
def test_equals_brute_force_and_adds_up_to_one(docs, heads):
    rows = corpus()
    df = id_and_text(docs(*rows))
    model = katz.fit(df, heads)
    want, sums = brute(rows, heads, model)
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    got = {r["doc_id"]: r for r in katz.evaluate(df, model).collect()}
    for i, n, known, total, base, score in want:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, not trained(i))
        assert abs(r["base_score"] - base) < 1e-5 and abs(r["score"] - score) < 1e-5


def test_rare_words_are_contexts_and_continuations_of_their_own(docs):
    from types import SimpleNamespace

    from factloom.llm.common import word_hashes

    rows = corpus(n=400) + [(1000 + i, f"w{i % 90} rare{i % 40} alike{i % 40} w1 rare{i % 7}") for i in range(300)]
    vocabulary = {x.encode() for i, t in rows if trained(i) for x in split(t)}
    df = id_and_text(docs(*rows))
    want, sums = brute(rows, 8, SimpleNamespace(heads=word_hashes(sorted(vocabulary))))
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    got = {r["doc_id"]: r for r in katz.evaluate(df, katz.fit(df, 8)).collect()}
    assert len(got) == len(want) and all(abs(got[i]["score"] - score) < 1e-5 for i, *_, score in want)


def test_odd_rows(docs, odd):
    got = katz.score(docs(*odd)).collect()
    assert len(got) == len(odd)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert katz.score(docs()).count() == 0


def test_texts_that_are_all_held_out(docs):
    ids = [i for i in range(200) if not trained(i)][:3]
    for r in katz.score(docs(*[(i, "some words here") for i in ids])).collect():
        assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["score"]) == (0, 0, 4, 0.0)


def test_one_word_over_and_over(docs):
    rows = [(i, "again " * 30) for i in range(40)]
    for r in katz.score(docs(*rows)).collect():
        assert math.isfinite(r["score"]) and r["score"] <= 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64)), rng.integers(-5, 2**40, 1000)
    x, y = katz.unpack(katz.pack(a, b), 2)
    assert (x == a).all() and (y == b).all()
    assert katz.unpack(katz.pack(a[:0], b[:0]), 2)[0].size == 0


def test_scores_depend_neither_on_partitions_nor_on_heads(spark, docs):
    random.seed(9)
    vocabulary = [f"w{int(random.paretovariate(0.8))}" for _ in range(4000)]
    df = id_and_text(docs(*[(i, " ".join(random.choice(vocabulary) for _ in range(random.randrange(40)))) for i in range(150)]))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions, heads in (("4", 64), ("13", 64), ("9", 1 << 18)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append({r["doc_id"]: (r["score"], r["base_score"]) for r in katz.evaluate(df, katz.fit(df, heads)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in found[1:]:
        assert all(found[0][i] == pytest.approx(other[i], abs=1e-6) for i in found[0])


def test_only_what_is_no_plain_scan_is_written_first(docs):
    df = id_and_text(docs((1, "a b"), (2, "c")))
    assert katz._steady(df) is df
    assert katz._steady(df.repartition(3)) is not df
