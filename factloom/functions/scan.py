"""Scanners of source text as Arrow UDFs, and FNV-1a. Each row is scanned once, in whole batches."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from factloom.functions.normal import normalized
from factloom.functions.script import lex

#: Names that nearly every module has (fixed values).
NOISE = frozenset("length name value key prototype constructor toString valueOf hasOwnProperty default type".split())
#: Words counted in a keyword histogram (fixed values).
COUNTED = "if else for while do switch case break continue return throw try catch finally function class extends new delete typeof instanceof in of var let const async await yield import export this super =>".split()

def arrow(returns: str):
    """A column function from one on pandas series; the UDF is made where it is used, as workers import this module without a session."""

    def wrap(f):
        @functools.wraps(f)
        def column(c: Column | str) -> Column:
            return pandas_udf(f, returns)(c)

        return column

    return wrap


def tokens(source: str | None) -> list[str]:
    """Tokens without comments; strings, templates and regular expressions are one token each, marks of several characters, but for =>, one token for each."""
    out: list[str] = []
    for t in lex(source or ""):
        if t.kind == "mark" and t.text != "=>":
            out += t.text
        else:
            out.append(t.text)
    return out


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_many(texts: list[bytes]) -> np.ndarray:
    """Hashes of many texts at once: one vector step per byte place."""
    n = len(texts)
    h = np.full(n, 0xCBF29CE484222325, np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    order = np.argsort(-lengths, kind="stable")
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.zeros(0, np.int64)
    starts, lengths = starts[order], lengths[order]
    out = h.copy()
    for k in range(int(lengths[0]) if n else 0):
        live = int(np.searchsorted(-lengths, -k, side="left"))
        h[:live] = (h[:live] ^ raw[starts[:live] + k]) * np.uint64(0x100000001B3)
    out[order] = h
    return out


@arrow("string")
def fnv1a_hex(texts: pd.Series) -> pd.Series:
    """16 hexadecimal figures; null for null."""
    known = texts.notna().to_numpy()
    out = np.full(len(texts), None, object)
    out[known] = [f"{h:016x}" for h in fnv1a_many([t.encode() for t in texts[known]]).tolist()]
    return pd.Series(out)


@arrow("array<string>")
def string_literals(sources: pd.Series) -> pd.Series:
    """Distinct contents, of four characters or more, of strings and of templates without substitutions."""

    def of(source: str | None) -> list[str]:
        found = {t[1:-1] for t in tokens(source) if t[0] in "\"'`" and len(t) >= 6 and not (t[0] == "`" and "${" in t)}
        return sorted(found)

    return sources.map(of)


def specifiers(source: str | None) -> list[str]:
    """Specifiers of import, export from, import() and require(), in order, each once."""
    ts, found = lex(source or ""), []
    for i, t in enumerate(ts):
        if t.kind != "string" or not i:
            continue
        before = [x.text for x in ts[max(0, i - 4) : i]]
        asked = before[-1] in ("from", "import") or before[-2:] in (["import", "("], ["require", "("]) or before == ["require", ".", "resolve", "("]
        if asked and len(t.text) > 2 and "\\" not in t.text:
            found.append(t.text[1:-1])
    return list(dict.fromkeys(found))


@arrow("array<string>")
def import_specifiers(sources: pd.Series) -> pd.Series:
    return sources.map(specifiers)


@arrow("array<string>")
def property_names(sources: pd.Series) -> pd.Series:
    """Distinct names of members, keys and methods, of three characters or more and not noise."""

    def of(source: str | None) -> list[str]:
        ts, found = tokens(source), set()
        for i, t in enumerate(ts):
            before, after = ts[i - 1] if i else "", ts[i + 1] if i + 1 < len(ts) else ""
            named = re.match(r"[A-Za-z_$]", t) and (before == "." or after == ":" and before in "{," or after == "(" and before in "{},;" and t not in COUNTED)
            literal = t[0] in "\"'" and (before == "[" and after == "]" or after == ":" and before in "{,")
            name = t[1:-1] if literal else t
            if (named or literal) and len(name) >= 3 and name not in NOISE:
                found.add(name)
        return sorted(found)

    return sources.map(of)


@arrow("array<int>")
def keyword_histogram(sources: pd.Series) -> pd.Series:
    """Counts of COUNTED, in that order."""
    place = {k: i for i, k in enumerate(COUNTED)}

    def of(source: str | None) -> list[int]:
        out = [0] * len(COUNTED)
        for t in tokens(source):
            if t in place:
                out[place[t]] += 1
        return out

    return sources.map(of)


@arrow("struct<source string, passes array<string>>")
def normalize(sources: pd.Series) -> pd.DataFrame:
    rows = [normalized(s or "") for s in sources]
    return pd.DataFrame({"source": [r[0] for r in rows], "passes": [r[1] for r in rows]})
