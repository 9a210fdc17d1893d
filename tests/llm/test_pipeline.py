import corpus_pipeline as p
import numpy as np
import pytest

from tests.compare import SMALL
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_packing import check_bins


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage keeps of the small documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"documents": docs}
    for name, stage in p.STAGES:
        docs = p.written(stage(spark, docs, SMALL))
        out[name] = docs
    return out


def test_stages_are_in_order():
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality rules", "line dedup", "n-gram Jaccard join", "best-fit packing"]


def test_columns_and_shrinking(stages):
    want, n = stages["documents"].dtypes, stages["documents"].count()
    for name, _ in p.STAGES[:-1]:
        assert stages[name].dtypes == want and 0 < stages[name].count() <= n
        n = stages[name].count()


def test_lines_as_by_brute_force(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["quality rules"].collect()]
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["line dedup"].collect()} == {i: (t, len(t)) for i, _, _, t in lines(before)}


def test_one_document_of_each_group_stays(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["line dedup"].collect()]
    assert sorted(r["doc_id"] for r in stages["n-gram Jaccard join"].collect()) == sorted(i for i, _, c in groups(before) if i == c)


def test_what_is_kept_is_packed(stages):
    rows = stages["best-fit packing"].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages["n-gram Jaccard join"].collect()}
    check_bins(rows, 2048)


def test_odd_and_empty_documents(spark, docs, odd):
    """Null, empty and blank texts have no words: they are toxic to nobody, fail the base rules, lose no line, are in no group and are packed."""
    df = docs(*odd)
    assert sorted(map(repr, p.reject_toxic(spark, df, SMALL).collect())) == sorted(map(repr, df.collect()))
    assert p.reject_poor(spark, df, SMALL).count() == 0
    assert [r["text"] for r in p.drop_lines(spark, df, SMALL).orderBy("doc_id", "text").collect()] == [t or "" for _, t in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    kept = p.drop_near_copies(spark, df, SMALL).collect()
    # One of the equal rows of 4 goes, and of 6 and 7, which are one word sequence, the latter.
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([x for x in dict.fromkeys(odd) if x[0] != 7], key=repr)
    assert p.pack(spark, df, SMALL).count() == len(odd)
    for name, stage in p.STAGES:
        assert stage(spark, docs(), SMALL).count() == 0, name


def test_columns_with_names_used_inside_are_carried_along(spark):
    text = PROSE.format("first", "two", "May")
    names = ["n_lines", "n_dropped", "_dropped", "_id", "row", "key", "doc", "lines", "c0", "judged", "first", "size", "_factloom_row", "n_chars"]
    df = spark.createDataFrame([(1, text, *range(len(names))), (2, text + " END", *range(10, 10 + len(names)))], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns, name
        got = {r["doc_id"]: r for r in out.collect()}
        assert set(got) == ({1} if "Jaccard" in name else {1, 2}), name
        assert [got[1][n] for n in names[:-1]] == list(range(len(names) - 1)), name


PROSE = "The committee met on the {} floor to discuss the harbour plans, and after {} hours of calm talk its members agreed that the new bridge would open to all walkers by the end of {}."


def test_verdicts_hold_for_a_row_and_not_for_its_id(spark, docs, monkeypatch):
    clean, bad = PROSE.format("first", "two", "May"), PROSE.format("third", "nine", "June") + " BAD"
    rows = [(None, clean), (None, bad), (7, clean), (7, bad), (8, None), (None, None)]
    monkeypatch.setattr(p.quality, "labels_table", lambda *_: spark.createDataFrame([], "doc_id long, toxic int, quality int"))
    monkeypatch.setattr(p.toxicity, "character_model", lambda *_: np.full((64, 64, 64), -4.0, np.float32))
    monkeypatch.setattr(p.toxicity, "fit", lambda *_: p.toxicity.Model({"bad": 6.0}, (-3.0, 1.0, 0.0, 0.0)))
    got = p.reject_toxic(spark, docs(*rows), SMALL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([x for x in rows if x[1] != bad], key=repr)
    poor = "the same eight words come up here again " * 6
    rows = [(None, clean), (None, poor), (7, clean), (7, poor), (7, clean + " More."), (8, None)]
    monkeypatch.setattr(p.quality, "fit", lambda *_: None)
    got = p.reject_poor(spark, docs(*rows), SMALL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([x for x in rows if x[1] not in (poor, None)], key=repr)


def test_near_copies_under_one_id_or_none(spark, docs):
    base = " ".join(f"word{k}" for k in range(80))
    other, third = " ".join(f"other{k}" for k in range(60)), " ".join(f"third{k}" for k in range(60))
    rows = [(None, base), (None, base + " tail"), (3, base + " end"), (5, base + " more"), (5, other), (None, third), (None, third), (None, third + " tail"), (None, None), (9, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in p.drop_near_copies(spark, docs(*rows), SMALL).collect()), key=repr)
    assert len([x for x in got if (x[1] or "").startswith("third")]) == 1
    assert [x for x in got if not (x[1] or "").startswith("third")] == sorted([(3, base + " end"), (5, other), (None, None), (9, "")], key=repr)
