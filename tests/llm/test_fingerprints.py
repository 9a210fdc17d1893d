import hashlib
import random

from pyspark.sql import functions as F

from factloom.llm import fingerprints


def edited(rows):
    """(id, sha of the edited text) by a plain sort."""
    order = sorted({(i, t) for i, t in rows}, key=lambda r: -r[0])
    after = {r: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    out = []
    for i, t in rows:
        t0, n = t or "", len(t or "") // 3
        out.append((i, len(t0), hashlib.sha256((t0[: len(t0) - n] + (after[i, t][1] or "")[:n]).encode()).hexdigest()))
    return sorted(out)


def query(spark, tmp_path, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return fingerprints.query(spark, str(tmp_path))


def test_edited_texts(spark, docs, tmp_path):
    random.seed(1)
    rows = [(i * 7, " ".join(random.choice(["alpha", "béta", "Γamma", "𝔡elta", "x"]) for _ in range(random.randrange(60)))) for i in range(400)] + [(3000, None), (3001, "")]
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in query(spark, tmp_path, docs(*rows)).collect()]
    assert sorted(got) == edited(rows)


def test_odd_rows(spark, docs, odd, tmp_path):
    rows = query(spark, tmp_path, docs(*odd)).collect()
    assert len(rows) == len(odd)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == "" and by_id[4]["fingerprint"] != ""
    assert by_id[6]["fingerprint"] == by_id[7]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert query(spark, tmp_path, docs()).count() == 0
    assert query(spark, tmp_path, docs((1, "only one"))).first()["near_next"] == 1.0


def test_the_sketch_is_what_brute_force_keeps(spark, docs):
    text = " ".join(f"w{k % 700}" for k in range(3000))
    df = fingerprints.with_sketch(docs((1, text)), F.col("text"), "s")
    words = df.select(F.transform(fingerprints.words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).first()["w"]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hashes = {r["h"] for r in df.sparkSession.createDataFrame(windows, "a long, b long, c long, d long, e long").select(F.xxhash64(*"abcde").alias("h")).collect()}
    assert df.first()["s"] == sorted(h for h in hashes if 0 <= h < 2**61)


def test_estimates_are_near_the_truth_and_merge(spark, docs):
    base = [f"word{k}" for k in range(4000)]
    long, part = " ".join(base), " ".join(base[:400])
    df = fingerprints.with_sketch(docs((1, long), (2, part)), F.col("text"), "s")
    a, b = (r["s"] for r in df.orderBy("doc_id").collect())
    pair = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    assert pair.select(fingerprints.containment(F.col("b"), F.col("a"))).first()[0] == 1.0
    assert abs(pair.select(fingerprints.likeness(F.col("a"), F.col("b"))).first()[0] - 0.099) < 0.05
    assert fingerprints.merged(df.withColumn("g", F.lit(1)), ["g"], "s").first()["s"] == sorted(set(a) | set(b))
