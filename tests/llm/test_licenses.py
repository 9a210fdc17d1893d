import random

import pytest

from factloom.llm import licenses


def test_every_notice_is_found_in_a_text(docs):
    names = sorted(licenses.TEMPLATES)
    rows = [(i, f"Some first line.\n  {licenses.TEMPLATES[name].upper()}  \nlast line") for i, name in enumerate(names)]
    got = licenses.scan(docs(*rows)).collect()
    assert sorted((r["doc_id"], r["line"], r["license"], r["exact"]) for r in got) == [(i, 1, name, True) for i, name in enumerate(names)]


def brute(text):
    """(line, license) of verbatim notices by comparing every template at every word; of overlapping ones the longest."""
    found, lines = [], []
    for k, line in enumerate(text.split("\n")):
        here = licenses.words(line)
        found += here
        lines += [k] * len(here)
    hits = []
    for name, template in licenses.TEMPLATES.items():
        t = licenses.words(template)
        hits += [(-len(t), name, i, i + len(t)) for i in range(len(found) - len(t) + 1) if found[i : i + len(t)] == t]
    out, taken = set(), []
    for _, name, a, b in sorted(hits):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.add((lines[a], name))
    return out


def test_verbatim_notices_as_by_brute_force(docs):
    random.seed(4)
    names, prose = sorted(licenses.TEMPLATES), "the river ran past a house where people licence boats and sing of work under a public bridge".split()
    rows = []
    for i in range(60):
        parts = []
        for _ in range(random.randrange(6)):
            parts.append(random.choice(["\n", " "]).join(random.choice(prose) for _ in range(random.randrange(1, 400))))
            parts.append(licenses.TEMPLATES[random.choice(names)])
        rows.append((i, random.choice(["\n", " "]).join(parts)))
    got = {(r["doc_id"], r["line"], r["license"]) for r in licenses.scan(docs(*rows)).filter("exact").collect()}
    assert got == {(i, *hit) for i, t in rows for hit in brute(t)}


def test_a_changed_word_is_reported(docs):
    text = licenses.TEMPLATES["mit-text"].replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("AUTHORS OR COPYRIGHT", "AUTHOR OR COPYRIGHT")
    (r,) = licenses.scan(docs((1, text))).collect()
    assert (r["license"], r["exact"], sorted(r["missing"]), sorted(r["extra"])) == ("mit-text", False, ["authors", "noninfringement"], ["author", "non-infringement"])


def test_near_wordings_are_told_apart(docs):
    rows = [(1, "This work is licensed under the GNU General Public License, version 2."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY 4.0.")]
    assert {r["doc_id"]: r["license"] for r in licenses.scan(docs(*rows)).collect()} == {1: "gpl-2.0", 2: "gpl-3.0", 3: "cc-by-nc-4.0", 4: "cc-by-4.0"}


def test_ordinary_prose_is_no_license(docs):
    rows = [(1, "She had a licence to drive and the permission of her mother."), (2, "the copyright of the song was disputed for many years in court"), (3, "Rights were reserved for later, all of them.")]
    assert licenses.scan(docs(*rows)).count() == 0


def test_a_notice_within_a_long_line(docs):
    line = "word " * 300 + licenses.TEMPLATES["mit"] + " more words" * 300
    assert [r["license"] for r in licenses.scan(docs((1, line))).collect()] == ["mit"]


def test_differences_are_exact():
    missing, extra = licenses.differences("a b c d e".split(), "x a b y d e z".split())
    assert (missing, extra) == (["c"], ["y"])


def test_odd_rows(docs, odd):
    assert licenses.scan(docs(*odd)).count() == 0
    assert licenses.scan(docs()).count() == 0


@pytest.mark.parametrize("mark", ["", " * ", "# ", "REM "])
def test_wrapped_notices_are_found(docs, mark):
    import textwrap

    wrapped = {name: "\n".join(mark + x for x in ["Some code.", *textwrap.wrap(text, 30, break_on_hyphens=False, break_long_words=False), "More of it."]) for name, text in licenses.TEMPLATES.items()}
    names = sorted(wrapped)
    got = licenses.scan(docs(*[(i, wrapped[name]) for i, name in enumerate(names)])).collect()
    assert {(names[r["doc_id"]], r["line"], r["license"], r["exact"]) for r in got} == {(name, 1, name, True) for name in names}


def test_every_notice_behind_long_prose_and_two_on_a_line(docs):
    prose = "The permission to use this library under a public license is provided by the committee, which may modify the conditions of the work; " * 24
    names = sorted(licenses.TEMPLATES)
    got = licenses.scan(docs(*[(i, prose + licenses.TEMPLATES[name]) for i, name in enumerate(names)])).collect()
    assert {(names[r["doc_id"]], r["license"]) for r in got} == {(name, name) for name in names}
    both = f"{licenses.TEMPLATES['mit']} {licenses.TEMPLATES['cc-by-4.0']} {licenses.TEMPLATES['all-rights-reserved']}"
    assert sorted(r["license"] for r in licenses.scan(docs((1, both))).collect()) == ["all-rights-reserved", "cc-by-4.0", "mit"]
