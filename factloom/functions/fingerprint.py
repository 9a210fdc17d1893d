"""Function fingerprints from source text: functions are found in its tree (by brackets where it doesn't parse), identifiers are numbered by
first use, and each axis hashes one aspect. Renaming a function's own names changes no axis; editing operators, loops or properties does."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.functions.scan import fnv1a, fnv1a_many, normalized, tokens
from factloom.functions.script import Node, Unparsed, lex, parse, walk

#: Names of the axes (fixed values).
AXES = ["ast", "cfg", "cfg_normalized", "return_pattern", "effect_pattern", "literal_anchor", "access_pattern", "structural_anchor", "literal_shape", "access_shape", "expression_shape", "callee_set", "binding_pattern", "throw_set"]
_FLOW = {"if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "throw", "try", "catch", "finally", "await", "yield"}
_WORDS = _FLOW | set("function class new delete typeof instanceof in of var let const async import export this super null true false undefined void default".split())
_NAME = re.compile(r"[A-Za-z_$]")


def _closing(ts: list[str], at: int) -> int:
    """The place of the bracket that closes the one at `at`, or the end."""
    depth = 0
    for k in range(at, len(ts)):
        depth += (ts[k] in "([{") - (ts[k] in ")]}")
        if not depth:
            return k
    return len(ts) - 1


def functions(source: str | None) -> list[tuple[int, int, list[str], list[str]]]:
    """(first token, last token, parameter tokens, body tokens) of every function, method and arrow, in order; an arrow's expression is a body that returns it."""
    try:
        tree = parse(source or "")
    except Unparsed:
        return _by_brackets(source)
    ts, starts = [], []
    for t in lex(source or ""):
        parts = list(t.text) if t.kind == "mark" and t.text != "=>" else [t.text]
        ts += parts
        starts += range(t.start, t.start + len(parts))
    cut = lambda a, b: ts[bisect.bisect_left(starts, a) : bisect.bisect_left(starts, b)]
    out = []
    for node, _, _ in walk(tree):
        if node.kind == "function":
            params = cut(node.params[0].start, node.params[-1].end) if node.params else []
            body = cut(node.body.start + 1, node.body.end - 1) if node.body.kind == "block" else ["return", *cut(node.body.start, node.body.end), ";"]
            out.append((bisect.bisect_left(starts, node.start), bisect.bisect_left(starts, node.end) - 1, params, body))
    return out


def _by_brackets(source: str | None) -> list[tuple[int, int, list[str], list[str]]]:
    """Functions with a block, by matching brackets, in text that doesn't parse."""
    ts, out = tokens(source), []
    for i, t in enumerate(ts):
        if t == "function":
            k = i + 1
            while k < len(ts) and ts[k] != "(":
                k += 1
            if k < len(ts):
                end = _closing(ts, k)
                if end + 1 < len(ts) and ts[end + 1] == "{":
                    close = _closing(ts, end + 1)
                    out.append((i, close, ts[k + 1 : end], ts[end + 2 : close]))
        elif t == "=>" and i + 1 < len(ts) and ts[i + 1] == "{":
            close, start = _closing(ts, i + 1), i - 1
            if ts[start] == ")":
                depth = 0
                while start >= 0:
                    depth += (ts[start] in ")]}") - (ts[start] in "([{")
                    if not depth:
                        break
                    start -= 1
            params = ts[start + 1 : i - 1] if ts[i - 1] == ")" else [ts[i - 1]]
            out.append((max(start, 0), close, params, ts[i + 2 : close]))
    return out


def _commas(ts: list[str]) -> int:
    depth = n = 0
    for t in ts:
        depth += (t in "([{") - (t in ")]}")
        n += t == "," and not depth
    return n


def _joined(parts) -> str | None:
    return "\x1f".join(parts) or None


def fingerprint(params: list[str], body: list[str]) -> tuple[int, int, dict[str, int | None]]:
    """(param_count, statement_count, hashes by axis): signed 64-bit, null for an axis without parts."""
    n, statements, axes = aspects(params, body)
    return n, statements, dict(zip(axes, hashed(list(axes.values())), strict=True))


def hashed(texts: list[str | None]) -> list[int | None]:
    """Signed 64-bit FNV-1a hashes of many texts at once."""
    there = [t.encode("utf-8", "surrogatepass") for t in texts if t is not None]
    found = iter(fnv1a_many(there).view("int64").tolist())
    return [None if t is None else next(found) for t in texts]


def aspects(params: list[str], body: list[str]) -> tuple[int, int, dict[str, str | None]]:
    """(param_count, statement_count, what each axis looks at)."""
    numbers: dict[str, str] = {}
    shape, accesses, callees, literals, throws, returns, effects, bindings = [], [], [], [], [], [], [], []
    ts = params + body
    for i, t in enumerate(ts):
        before, after = ts[i - 1] if i else "", ts[i + 1] if i + 1 < len(ts) else ""
        if _NAME.match(t):
            if before == ".":
                shape.append("." + t)
                accesses.append(t)
                if after == "(":
                    callees.append(t)
            elif t in _WORDS:
                shape.append(t)
            else:
                own = numbers.setdefault(t, f"v{len(numbers)}")
                shape.append(own)
                if before in ("var", "let", "const"):
                    bindings.append(before)
                if after in ("=", "+", "-") and i + 2 < len(ts) and ts[i + 2] in ("=", "+", "-"):
                    effects.append(after)
                elif after == "=":
                    effects.append("=")
        elif t[0] in "\"'`":
            shape.append("str")
            literals.append(t[1:-1])
        elif t[0].isdigit():
            shape.append("num")
            literals.append(t)
        else:
            shape.append(t)
        if t == "throw" and after == "new" and i + 2 < len(ts):
            throws.append(ts[i + 2])
        if t == "return":
            returns.append("void" if after in (";", "}", "") else "str" if after[:1] in "\"'`" else "num" if after[:1].isdigit() else "value")
    flow = [t for t in body if t in _FLOW]
    loops = ["loop" if t in ("for", "while", "do") else t for t in flow]
    anchors = sorted({x for x in literals if len(x) >= 4})
    axes = {
        "ast": _joined(["fn", *shape]), "cfg": _joined(["cfg", *flow]), "cfg_normalized": _joined(["cfg", *loops]), "return_pattern": _joined(["ret", *returns]), "effect_pattern": _joined(["eff", *effects]),
        "literal_anchor": _joined(anchors), "access_pattern": _joined(accesses), "structural_anchor": _joined([str(len(params)), *flow, *sorted(set(accesses))]), "literal_shape": _joined(["s" if not x[:1].isdigit() else "n" for x in literals]),
        "access_shape": _joined(sorted(set(accesses))), "expression_shape": _joined([t for t in body if not _NAME.match(t) and t[0] not in "\"'`" and t not in "(){};,"]), "callee_set": _joined(sorted(set(callees))),
        "binding_pattern": _joined(["bind", *bindings]), "throw_set": _joined(sorted(set(throws))),
    }
    return _commas(params) + bool(params), body.count(";") + sum(t in _FLOW for t in body), axes


SCHEMA = "doc long, pass string, fn int, span_start int, span_end int, params int, statements int, " + ", ".join(f"{a} long" for a in AXES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], []
        for doc, source in zip(batch.column("doc").to_pylist(), batch.column("source").to_pylist(), strict=True):
            texts = [("primary", source)]
            plain, used = normalized(source or "")
            if used:
                texts.append(("+".join(used), plain))
            for name, text in texts:
                for k, (start, end, params, body) in enumerate(functions(text)):
                    n, statements, axes = aspects(params, body)
                    out.append([doc, name, k, start, end, n, statements])
                    held += [axes[a] for a in AXES]
        hashes = hashed(held)
        for i, row in enumerate(out):
            row += hashes[i * len(AXES) : (i + 1) * len(AXES)]
        if out:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[c.split()[1]] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)


def fingerprints(sources: DataFrame) -> DataFrame:
    """A row for each function of sources (doc, source), and one more for its normalised form where that differs."""
    return sources.select("doc", "source").mapInArrow(_rows, SCHEMA)


FACTS = "doc long, fn int, name string, form string, span_start int, span_end int, params array<string>, callees array<string>, reads array<string>, writes array<string>, calls array<int>"


def facts_of(source: str | None) -> list[tuple]:
    """(fn, name, form, start, end, parameter names, callees, free names read, free names written, functions called) of each function of a text; none where it doesn't parse.

    A call edge leads to the function of that name that is declared in an enclosing function or at the top, the innermost one first.
    """
    try:
        tree = parse(source or "")
    except Unparsed:
        return []
    found: list[dict] = []
    number: dict[int, int] = {}
    declared: dict[tuple[int, str], int] = {}
    # What each function holds itself, without what functions inside it hold.
    stack: list[tuple[Node, str, Node | None, int, str]] = [(tree, "", None, -1, "")]
    while stack:
        node, role, parent, owner, binds = stack.pop()
        # Names in the patterns of parameters and declarations are the function's own; their default values are not.
        if role in ("params", "target"):
            binds = role
        elif not (role in ("parts", "value", "left") and parent.kind in ("object", "array", "property", "spread", "assign")):
            binds = ""
        here = owner
        if node.kind == "function":
            name = node.name
            if name is None and parent is not None and parent.kind == "declarator" and parent.target.kind == "name":
                name = parent.target.name
            here = number[id(node)] = len(found)
            found.append({"node": node, "name": name, "owner": owner, "params": [], "own": set(), "callees": [], "reads": {}, "writes": {}})
            if name and node.form != "method":
                declared.setdefault((owner, name), here)
        mine = found[owner] if owner >= 0 else None
        if mine is not None and node.kind == "name":
            if binds:
                if binds == "params":
                    mine["params"].append(node.name)
                mine["own"].add(node.name)
            else:
                _note(mine, node, role, parent)
        elif mine is not None and node.kind == "call":
            c = node.callee
            mine["callees"].append(c.name if c.kind in ("name", "member") else None)
        stack += [(child, r, node, here, "" if node.kind == "function" else binds) for r, child in reversed(list(node.children()))]
    out = []
    for i, f in enumerate(found):
        node, own = f["node"], f["own"]
        calls = []
        for name in dict.fromkeys(c for c in f["callees"] if c):
            at = i
            while at is not None:
                if (at, name) in declared:
                    calls.append(declared[at, name])
                    break
                at = None if at < 0 else found[at]["owner"]
        free = lambda names: [n for n in names if n not in own]  # noqa: B023, E731
        out.append((i, f["name"], node.form, node.start, node.end, f["params"], list(dict.fromkeys(c for c in f["callees"] if c)), free(f["reads"]), free(f["writes"]), calls))
    return out


def _note(f: dict, node: Node, role: str, parent: Node | None) -> None:
    """Whether a name is read, written or both in the function it stands in."""
    if parent is not None and (parent.kind == "assign" and role == "left" or parent.kind == "update"):
        f["writes"].setdefault(node.name)
        if parent.kind == "update" or parent.op != "=":
            f["reads"].setdefault(node.name)
    else:
        f["reads"].setdefault(node.name)


def _fact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*[c.split() for c in FACTS.split(", ")], strict=True)
    for batch in batches:
        rows = [(doc, *row) for doc, source in zip(batch.column("doc").to_pylist(), batch.column("source").to_pylist(), strict=True) for row in facts_of(source)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def function_facts(sources: DataFrame) -> DataFrame:
    """Names, parameters, callees, references and call edges of each function of sources (doc, source)."""
    return sources.select("doc", "source").mapInArrow(_fact_rows, FACTS)


def axis_rows(prints: DataFrame) -> DataFrame:
    """(doc, fn, pass, axis, hash), without nulls: the shape that joins take."""
    from pyspark.sql import functions as F

    stacked = ", ".join(f"'{a}', {a}" for a in AXES)
    return prints.select("doc", "fn", "pass", F.expr(f"stack({len(AXES)}, {stacked}) as (axis, hash)")).filter("hash is not null")


def frame(source: str) -> pd.DataFrame:
    """The fingerprints of one text, for a look at them."""
    return pd.DataFrame([{"params": n, "statements": s, **axes} for n, s, axes in (fingerprint(p, b) for _, _, p, b in functions(source))])


def bracket_tree(source: str | None) -> list[tuple[str, list[int]]]:
    """(label, children) of every node of a text's bracket tree, the root first; names count as one label."""
    nodes: list[tuple[str, list[int]]] = [("root", [])]
    stack = [0]
    for t in tokens(source):
        if t in ")]}":
            if len(stack) > 1:
                stack.pop()
            continue
        label = "str" if t[0] in "\"'`" else "num" if t[0].isdigit() else "name" if _NAME.match(t) and t not in _WORDS else t
        nodes[stack[-1]][1].append(len(nodes))
        nodes.append((label, []))
        if t in "([{":
            stack.append(len(nodes) - 1)
    return nodes


def pq_grams(source: str | None, p: int = 2, q: int = 3) -> list[str]:
    """Each node with p - 1 ancestors and every q children in a row, * where there is none; a bag, sorted."""
    nodes, out = bracket_tree(source), []
    stack = [(0, ("*",) * (p - 1))]
    while stack:
        at, above = stack.pop()
        label, children = nodes[at]
        stem = (*above, label)
        row = ["*"] * (q - 1) + [nodes[c][0] for c in children] + ["*"] * (q - 1) if children else ["*"] * q
        out += [" ".join((*stem, *row[k : k + q])) for k in range(len(row) - q + 1)]
        stack += [(c, stem[1:]) for c in children]
    return sorted(out)


def wl_hashes(source: str | None, rounds: int = 3) -> list[int]:
    """Weisfeiler-Lehman labels of all nodes after some rounds, as sorted hashes: what a node's surroundings look like."""
    nodes = bracket_tree(source)
    labels = [label for label, _ in nodes]
    for _ in range(rounds):
        labels = [f"{fnv1a('|'.join([labels[k], *sorted(labels[c] for c in children)]).encode()):x}" for k, (_, children) in enumerate(nodes)]
    return sorted(int(x, 16) if rounds else fnv1a(x.encode()) for x in labels)
