"""The lexer and parser, and a fixture for each normalisation pass."""

import time

import pytest

from factloom.functions import fingerprint as fp
from factloom.functions import normal, scan
from factloom.functions.script import Unparsed, lex, parse, walk

TEXTS = [
    "a=1", "if(a)b;else c", "for(;;){}", "for(var i=0,n=3;i<n;i++)x(i)", "for(const a of b)c", "do x();while(y)", "switch(a){case 1:b;break;default:c}", "try{a}catch{b}finally{c}", "async (a,b)=>{await c}",
    "(a,{b,c=2},...d)=>({e:1})", "class A extends B{static x=1;#p=2;get y(){return 1}static async *z(){yield* q}constructor(){super()}static{a}}", "a?.b?.[c]?.(d)", "new A.B(c).d", "x=/[\"'\\/]/g.test(y)/2",
    "a=b/c/d", "`a${`b${\"}\"}`}c`", "label:for(;;)break label", 'import a,{b as c}from"x"', "export default function(){}", 'export*from"q"', "({get a(){return 1},async b(){},*c(){},[d]:1,\"e\":2,3:4,f})", "a\n++b", "a=b?c:d?e:f", "a**b**c", "0x1F+1e3+.5+1_000n",
]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_parse_and_nodes_lie_within_their_parents(text):
    for node, parent, _ in walk(parse(text)):
        assert 0 <= node.start <= node.end <= len(text)
        assert parent is None or parent.start <= node.start and node.end <= parent.end


@pytest.mark.parametrize("text", ["a=", "if(", "}{", "f(a", "var 1", "x = )", "const"])
def test_broken_texts_raise_and_stay_as_they_are(text):
    with pytest.raises(Unparsed):
        parse(text)
    assert normal.normalized(text) == (text, [])


def test_regular_expressions_and_strings_are_told_apart():
    kinds = {t.text: t.kind for t in lex("x = /['\"]/; y = 'real string here'; z = a / b / c; // 'no'\nw = \"http://x/y\"")}
    assert kinds["/['\"]/"] == "regex" and kinds["'real string here'"] == "string" and kinds["/"] == "mark" and kinds['"http://x/y"'] == "string"
    assert scan.specifiers('import a from "http://x.y/z"; // import b from "no"') == ["http://x.y/z"]


#: A text that a pass rewrites, and what comes out after all passes.
PASSES = {
    "parenthesized_expression_unwrapped": ("x = ((a + b));", "x = a + b;"),
    "ts_runtime_erased": ("interface A { b: string }\nf();", "\nf();"),
    "jsx_runtime_normalized": ('x = (0, r.jsxs)("a", {});', 'x = _jsx("a", {});'),
    "bundler_wrapper_unwrapped": ('x = __toESM(require("y"), 1);', 'x = require("y");'),
    "helper_identity_inlined": ("function id(q) { return q; }\nuse(id(42));", "function id(q) { return q; }\nuse(42);"),
    "export_boundary_normalized": ("export function f() { g(); }", "function f() { g(); }"),
    "commonjs_export_boundary_normalized": ("exports.add = function (a) { return a; };", "function add(a) { return a; }"),
    "closure_boundary_aligned": ("(() => { let x = 1; })();", "let x = 1;"),
    "boolean_undefined_canonicalised": ("x = !0; y = !1;", "x = true; y = false;"),
    "declarator_split": ("var a = 1, b = 2;", "var a = 1; var b = 2;"),
    "sequence_expression_split": ("a(), b();", "a(); b();"),
    "logical_short_circuit_expanded": ("x && f(); y || g();", "if (x) { f(); } if (!y) { g(); }"),
    "conditional_negation_flipped": ("x = !c ? a : b;", "x = c ? b : a;"),
    "conditional_statement_expanded": ("c ? f() : g();", "if (c) { f(); } else { g(); }"),
    "return_conditional_expanded": ("function f(c) { return c ? 1 : 2; }", "function f(c) { if (c) { return 1; } return 2; }"),
    "computed_to_static_member": ('x = o["a"]["b c"];', 'x = o.a["b c"];'),
    "arrow_body_blocked": ("f = (a) => a + 1;", "f = (a) => { return a + 1; };"),
    "compound_assignment_canonical": ("o.n = o.n + 1;", "o.n += 1;"),
    "logical_compound_assignment_canonical": ("x = x ?? v;", "x ??= v;"),
    "if_return_else_flattened": ("function f(c) { if (c) { return 1; } else { g(); } }", "function f(c) { if (c) { return 1; } g(); }"),
    "equality_negation_flattened": ("x = !(a === b);", "x = a !== b;"),
    "relational_operand_canonicalised": ("x = 0 < n;", "x = n > 0;"),
    "constant_string_concat_folded": ('x = "a" + "b" + "c";', 'x = "abc";'),
    "logical_not_chain_flattened": ("x = !!!a;", "x = !a;"),
    "template_no_substitution_lowered": ("x = `plain`;", 'x = "plain";'),
    "infinite_for_to_while": ("for (;;) { f(); }", "while (true) { f(); }"),
    "for_to_while_finite": ("for (; n > 0; ) { n--; }", "while (n > 0) { n--; }"),
    "conditional_boolean_coerced": ("x = a ? true : false; y = b ? false : true;", "x = !!a; y = !b;"),
    "trailing_return_void_removed": ("function f() { g(); return; }", "function f() { g();  }"),
    "void_zero_to_undefined": ("x = void 0;", "x = undefined;"),
    "boolean_call_to_double_not": ("x = Boolean(a && b);", "x = !!(a && b);"),
    "nullish_equality_compacted": ("x = a === null || a === undefined;", "x = a == null;"),
    "typeof_local_undefined_guarded": ('function f(x) { return typeof x === "undefined"; }', "function f(x) { return x === undefined; }"),
    "nullish_assignment_compacted": ("if (o.x == null) { o.x = v; }", "o.x ??= v;"),
    "empty_else_block_removed": ("if (c) { f(); } else {}", "if (c) { f(); } "),
    "statement_body_blocked": ("while (a) f();", "while (a) { f(); }"),
}


def test_every_pass_has_a_fixture():
    assert [f.__name__ for f in normal.PASSES] == list(PASSES)


@pytest.mark.parametrize("name", PASSES)
def test_pass(name):
    before, after = PASSES[name]
    got, used = normal.normalized(before)
    assert got == after and name in used
    assert normal.normalized(got) == (got, [])


@pytest.mark.parametrize("text", ['"use !0 here; void 0";', "x = 'if (a) {} else {}';", "x = /!0\"void 0/;", "x = `!0 ${void_ + `for (;;) {}`}`;", "function f() { let undefined = 1; return void 0; }", "x = a?.b || (c ?? d);", "// void 0\nf();"])
def test_what_is_no_code_or_guarded_is_left_alone(text):
    assert normal.normalized(text) == (text, [])


def test_strings_are_never_changed():
    text = "\n".join(f"{before.rstrip()} s{i} = 'void 0; !0 ? (a) : b'; r{i} = /for (;;) !0/;" for i, (before, _) in enumerate(PASSES.values()) if "=>" not in before and "interface" not in before)
    got, used = normal.normalized(text)
    assert len(used) > 20
    assert [t.text for t in lex(got) if t.kind == "regex" or t.text.startswith("'void")] == [t.text for t in lex(text) if t.kind == "regex" or t.text.startswith("'void")]


def test_functions_of_every_form():
    found = fp.functions("const f = a => a + 1; class A { m(x, y) { return x; } get z() { return 1; } } const o = { n() {} }; function g() { return () => {}; }")
    assert [fp.fingerprint(p, b)[0] for _, _, p, b in found] == [1, 2, 0, 0, 0, 0]


def test_facts_of_functions(spark):
    source = "function outer(a, {b}) { const c = helper(a); function inner() { total += c; return outer(1); } inner(); api.send(x); } function helper(q) { return q; }"
    by = {r[1]: r for r in fp.facts_of(source)}
    assert by["outer"][6:8] == (["helper", "inner", "send"], ["helper", "inner", "api", "x"])
    assert [by["outer"][9], by["inner"][9]] == [[by["helper"][0], by["inner"][0]], [by["outer"][0]]]
    assert by["inner"][8] == ["total"] and by["outer"][5] == ["a", "b"]
    rows = fp.function_facts(spark.createDataFrame([(1, source), (2, None), (3, "} broken")], "doc long, source string")).collect()
    assert [(r["doc"], r["name"]) for r in rows] == [(1, "outer"), (1, "inner"), (1, "helper")]


def test_time_grows_with_the_length():
    def took(n):
        source = "function f(x) { " + 'var a = b(x, "text", e.f[0]); if (a > 1) { return a; } ' * n + "}"
        began = time.perf_counter()
        ((_, _, params, body),) = fp.functions(source)
        fp.fingerprint(params, body)
        return time.perf_counter() - began, len(body)

    took(100)
    (small, _), (large, tokens) = took(1000), took(4500)
    assert tokens > 100_000 and large < 4.5 * 2.5 * small + 0.5


#: A function as a library's earlier and later release have it: names, messages and a value differ, or a statement is added.
DRIFT = [
    ("function add(list, item) { var found = false; for (var i = 0; i < list.length; i++) { if (list[i].id === item.id) { found = true; } } if (!found) { list.push(item); } return list; }",
     "function add(items, x) { var seen = false; for (var j = 0; j < items.length; j++) { if (items[j].id === x.id) { seen = true; } } if (!seen) { items.push(x); } return items; }"),
    ("function load(url, done) { var request = open(url); request.on('end', function (body) { if (!body) { throw new Error('no body'); } done(null, body); }); return request; }",
     "function load(url, cb) { var req = open(url); req.on('end', function (text) { if (!text) { throw new Error('empty body received'); } cb(null, text); }); return req; }"),
    ("function clamp(n, lo, hi) { if (n < lo) { return lo; } if (n > hi) { return hi; } return n; }", "function clamp(value, least, most) { if (value < least) { return least; } if (value > most) { return most; } return value; }"),
    ("function keys(o) { var out = []; for (var k in o) { if (o.hasOwnProperty(k)) { out.push(k); } } return out; }", "function keys(o) { var out = []; if (!o) { return out; } for (var k in o) { if (o.hasOwnProperty(k)) { out.push(k); } } return out; }"),
]


@pytest.mark.parametrize(("axis", "least"), [("ast", 0.0), ("cfg", 0.66), ("structural_anchor", 0.66), ("binding_pattern", 0.66)])
def test_axes_survive_minor_drift(axis, least):
    """The published bounds, on pairs of our own."""
    of = lambda source: fp.fingerprint(*fp.functions(source)[0][2:])[2][axis]
    assert sum(of(a) == of(b) for a, b in DRIFT) / len(DRIFT) >= least
