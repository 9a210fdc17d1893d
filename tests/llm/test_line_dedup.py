import hashlib
from collections import defaultdict

from factloom.llm import line_dedup

WS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5):
    """(id, n_lines, n_dropped, kept) of each row."""
    holders = defaultdict(set)
    low = -(2**63)
    key = lambda line: line.strip(WS).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or (low if i is None else i) == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def run(df, **args):
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(df, **args).collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_odd_rows(docs, odd):
    same(run(docs(*odd)), brute(odd))
    assert run(docs()) == []


def test_shared_lines_go_but_for_the_last_holder(docs):
    common = "This Line is shared by many documents, ÄÖ and long enough"
    rows = [(i, f"own line {i}\n  {common.upper() if i % 2 else common}\t\nend\n{common}") for i in range(8)] + [(9, f"{common}\n{common}"), (None, common)]
    same(run(docs(*rows)), brute(rows))
    kept = {i: k for i, _, _, k in run(docs(*rows))}
    assert kept[9] == f"{common}\n{common}" and common not in kept[0]


def test_four_documents_and_short_lines_are_left_alone(docs):
    four = "x" * 40
    rows = [(i, f"{four}\n{'y' * 39}") for i in range(4)] + [(i, "y" * 39) for i in range(10, 20)] + [(0, four)]
    same(run(docs(*rows)), brute(rows))
    assert all(d == 0 for _, _, d, _ in run(docs(*rows)))


def test_only_ascii_is_lowered_and_stripped(docs):
    a, b = "É" + "a" * 45, "é" + "a" * 45
    rows = [(i, a) for i in range(3)] + [(i, b) for i in range(3, 6)] + [(i, " " + a) for i in range(6, 9)]
    same(run(docs(*rows)), brute(rows))


def test_a_long_text(docs):
    rows = [(i, "\n".join(f"line number {k} of a long text that goes on and on" for k in range(3000))) for i in range(6)]
    same(run(docs(*rows)), brute(rows))


def test_other_columns_stay(docs):
    out = line_dedup.dedup_lines(docs((1, "a")))
    assert set(docs((1, "a")).columns) <= set(out.columns)


def test_query_hashes_what_is_kept(spark, tmp_path, docs):
    rows = [(i, f"{'shared line ' * 5}\nrow {i}") for i in range(7)]
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.query(spark, str(tmp_path)).collect()]
    same(got, [(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows)])
