import random
import re

import numpy as np

from factloom.llm import quality


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_counts():
    random.seed(4)
    texts = [None, "", " \n\t", "a", "x y z " * 10, "a b c d e f g h\na b c d e f g h", "é ü # * |\n|\n |\n\n", "one\x85two\xa0three"]
    texts += [" ".join(random.choice("abc") for _ in range(random.randrange(40))) + random.choice(["", "\nq\nq"]) for _ in range(150)]
    for t in texts:
        assert quality.statistics(t or "")[0] == brute(t), repr(t)


def test_trees_learn_and_keep_their_directions():
    rng = np.random.default_rng(2)
    x = rng.random((1500, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3)).astype(float)
    y[rng.random(1500) < 0.05] = 1
    forest = quality.grow(x, y, [-1, 0, 0], trees=40)
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.93
    for _ in range(50):
        line = np.repeat(rng.random((1, 3)), 60, axis=0)
        line[:, 0] = np.linspace(0, 1, 60)
        assert (np.diff(forest.score(line)) <= 1e-12).all()
    up = quality.grow(x, 1 - y, [1, 0, 0], trees=40)
    line[:, 1:] = 0.5
    assert (np.diff(up.score(line)) >= -1e-12).all()


def test_flat_arrays_equal_a_walk_of_each_tree():
    rng = np.random.default_rng(5)
    x, y = rng.random((300, 2)), rng.integers(0, 2, 300).astype(float)
    forest = quality.grow(x, y, [0, 0], trees=5, depth=3)
    for row, got in zip(x[:40], forest.score(x[:40])):
        total = forest.start
        for node in forest.first:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


def test_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    df = docs(*odd, (20, " ".join(f"w{k}" for k in range(30))), (21, "same words all over again and again here " * 9))
    forest = quality.fit(df, labels)
    assert forest is None
    got = {r["doc_id"]: r for r in quality.judge(df, forest).collect()}
    assert got[1]["base_failed"] and not got[1]["kept"] and got[1]["n_words"] == 0
    assert got[20]["kept"] and got[21]["base_failed"]
    assert quality.judge(docs(), None).count() == 0


def test_poor_texts_are_told_from_good_ones(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randrange(2, 8)))
    rows = []
    for i in range(500):
        good = i % 4 > 0
        t = " ".join(word() + ("." if k % 12 == 11 else "") for k in range(60)) if good else " | ".join(word().upper() for _ in range(60))
        rows.append((i, t, int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert sum(got[i] == bool(y) for i, _, y in rows) / len(rows) > 0.99
