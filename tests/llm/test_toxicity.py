import random
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import toxicity
from factloom.llm.common import id_and_text

BAD = ["idiot", "stupid", "worthless"]


def corpus(n=600, seed=3):
    """(id, text, label): every fifth text holds a bad word or two among invented ones."""
    random.seed(seed)
    vocabulary = ["".join(random.choice(["ba", "ne", "lo", "tri", "sum", "ka", "or"]) for _ in range(random.randrange(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [random.choice(vocabulary) for _ in range(random.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(random.randrange(1, 3)):
                w.insert(random.randrange(len(w)), random.choice(BAD))
        rows.append((i, " ".join(w), int(bad)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_held_out_accuracy_and_schema(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.98
    assert not any(p and not y for p, y in held)


@pytest.mark.parametrize("text", ["you 1diot", "such an i d i o t here", "so stuuuupid", "w.o.r.t.h.l.e.s.s stuff", "$tupid", "IDIOT!!", "s t u p i d", "id" + "i" * 60 + "ot", "i*d*i*o*t", "s/t/u/p/i/d", "s   t   u   p   i   d", "\u0456di\u043et", "stu\u200bpid", "x1" * 30 + "-1d10t-" + "2y" * 30, "w.o.r.t.h.l.e.s.s. " * 12])
def test_disguises_are_seen_through(spark, rows, text):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    restorer = toxicity.Restorer(toxicity.character_model(docs))
    assert any(w in restorer(text) for w in BAD)


@pytest.mark.parametrize("text", ["call 45.114.23.72 now", "4348649190265535", "plain words, with stops. and!! marks", "e.g. this", "v2 of it", "", "a"])
def test_ordinary_texts_are_left_alone(text):
    import numpy as np

    model = np.full((64, 64, 64), -4.0, np.float32)
    assert toxicity.Restorer(model)(text) == text.lower()


def test_viterbi_is_the_best_of_all_readings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    model = rng.normal(-4, 2, (64, 64, 64)).astype(np.float32)
    r = toxicity.Restorer(model)
    for stretch in ("a1b", "x3ee4", "b00m", "t!1"):
        best = None
        for path in itertools.product(*[r.options(stretch, i) for i in range(len(stretch))]):
            a = b = 0
            total = 0.0
            for (out, cost), c in zip(path, stretch):
                if out:
                    k = int(toxicity.CODE[min(ord(out), 0x17F)])
                    total += float(model[a, b, k]) - cost
                    a, b = b, k
                else:
                    total -= cost + (1.5 if c.isalnum() else 0)
            total += float(model[a, b, 0])
            if best is None or total > best[0]:
                best = total, "".join(out for out, _ in path)
        assert r._viterbi(stretch) == best[1]


def test_character_counts_cover_all_texts(spark, docs):
    df = id_and_text(docs((1, "abc"), (2, None), (3, "")))
    got = df.mapInArrow(toxicity._count, "pair int, next int, n long").groupBy("pair", "next").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in got) >= 3
    a, b, c = (int(toxicity.CODE[ord(x)]) for x in "abc")
    assert {(r["pair"], r["next"]) for r in got} >= {(a * 64 + b, c)}


def test_odd_rows_and_tables_without_labels(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs(*odd), none).collect()
    assert len(got) == len(odd) and all(r["predicted"] == 0 for r in got)
    strange = spark.createDataFrame([(1, None), (None, 1), (99, 1), (4, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs(*odd), strange).count() == len(odd)
    assert toxicity.score(docs(), none).count() == 0


def test_a_repeated_id_is_learnt_from_once(spark, rows):
    """One labelled id that very many rows share adds one text to what is learnt from."""
    from factloom.llm.common import one_text_each

    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    many = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("idiot row "), "id").alias("text"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, y int")
    got = one_text_each(docs.union(many), labels)
    assert got.count() == len(rows) and got.select("doc_id").distinct().count() == len(rows)
    assert got.filter("doc_id = 1").first() == one_text_each(many.union(docs).repartition(7), labels).filter("doc_id = 1").first()


def test_stretches_are_those_that_the_whole_pattern_finds():
    random.seed(1)
    for _ in range(20_000):
        x = "".join(random.choice("aab1@ ._-*! /\u200b\u0430\u043e\U0001d41a_(|\u00e9~\n") for _ in range(random.randrange(1, 40)))
        assert [m.span() for m in toxicity._DISGUISED.finditer(x)] == [m.span() for a, b in toxicity.suspicious(x) for m in toxicity._DISGUISED.finditer(x, a, b)]
