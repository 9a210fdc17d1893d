import pandas as pd
import pytest

from factloom.llm import chat
from tests.compare import SMALL, comparable, database

SCHEMA = "conv_id long, turn long, role string, text string, conv string, part int"


def brute(rows):
    talks = {}
    for c, n, role, text in set(rows):
        talks.setdefault(c, []).append((-(2**63) if n is None else n, role or "", text or ""))
    whole = {c: tuple(x[1:] for x in sorted(t)) for c, t in talks.items()}
    out = []
    for c, t in whole.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in whole.values()):
            continue
        equal = [k for k, o in whole.items() if o == t]
        if c == min(equal, key=lambda k: -(2**63) if k is None else k):
            out.append((c, len(t), len(equal), "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in t)))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, chat.format_chats(df).collect()), key=repr)


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    rows = [(c, k, *t) for c, n in ((1, 2), (2, 3), (3, 4), (4, 4), (5, 1)) for k, t in enumerate(talk[:n])]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, "assistant", "hi")]
    assert run(spark, rows) == brute(rows)
    assert [r[0] for r in run(spark, rows)] == [3, 6, 7]


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", ""), (2, 5, "user", "a"), (2, 5, "user", "a"), (2, 5, "user", "b"), (3, 9, "user", "a")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_a_long_conversation_is_placed_in_parts(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(500)] + [(2, 1000 + k, "user", f"t{k}") for k in range(300)]
    got = run(spark, rows)
    assert got == brute(rows) and got[0][1] == 500


@pytest.mark.skipif(not SMALL, reason="no test data")
def test_sql_twin(spark):
    got = chat.query(spark, SMALL).toPandas()
    pd.testing.assert_frame_equal(comparable(got), comparable(database(SMALL).sql(chat.ORACLE_SQL).df()))
