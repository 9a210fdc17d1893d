"""Rewrites of script text to a common form: thirty-six passes over the tree, each a list of edits to the text.

A pass says which stretches to replace by what; all else, strings and comments included, stays as it is. Passes run in order, each until it
finds nothing more, and all again until none does. Text that doesn't parse is left as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from factloom.functions.script import Node, Unparsed, parse, walk

Edit = tuple[int, int, str]
#: Rounds of all passes, and of one pass, before a text counts as never settling.
ROUNDS = 200

_NAME = re.compile(r"[A-Za-z_$][\w$]*\Z")
_SIMPLE = frozenset("name word string number template regex member index call array tagged paren new".split())
_LISTS = frozenset(("program", "block", "case"))


class Script:
    """A text with its tree, and what the passes ask of both."""

    def __init__(self, source: str):
        self.source, self.tree = source, parse(source)
        self.nodes = list(walk(self.tree))

    def __call__(self, node: Node) -> str:
        return self.source[node.start : node.end]

    def of(self, *kinds: str) -> Iterator[tuple[Node, Node | None, str]]:
        return (x for x in self.nodes if x[0].kind in kinds)

    def wrapped(self, node: Node) -> str:
        """The text of an expression, in parentheses unless it needs none under an operator."""
        return self(node) if node.kind in _SIMPLE else f"({self(node)})"

    def bound(self, name: str) -> bool:
        """Whether the text itself binds a name, or has a with statement that might."""
        for node, parent, role in self.nodes:
            if node.kind == "with" or node.kind in ("function", "class") and node.name == name and node.fields.get("form") != "method":
                return True
            if node.kind == "name" and node.name == name and (role in ("target", "params") or role == "left" and parent.kind == "assign"):
                return True
            if node.kind == "import" and any(inner == name for _, inner in node.names):
                return True
        return False

    def undefined(self, node: Node) -> bool:
        return node.kind == "name" and node.name == "undefined" or node.kind == "unary" and node.op == "void" and node.value.kind == "number"


def bare(node: Node) -> Node:
    while node.kind == "paren":
        node = node.value
    return node


def _leaves(node: Node | None) -> bool:
    """Whether a statement never goes on to the next one."""
    if node is None:
        return False
    if node.kind == "block":
        return bool(node.body) and _leaves(node.body[-1])
    return node.kind in ("return", "throw", "break", "continue")


def _inner(s: Script, node: Node) -> str:
    """A statement's text, a block's without its braces."""
    return s.source[node.start + 1 : node.end - 1].strip() if node.kind == "block" else s(node)


#: Where an expression stands by itself, so that parentheses say nothing.
_FREE = {("declarator", "init"), ("assign", "right"), ("return", "value"), ("throw", "value"), ("call", "args"), ("new", "args"), ("paren", "value"), ("array", "parts"), ("property", "value"), ("index", "key"), ("conditional", "yes"), ("conditional", "no"), ("if", "test"), ("while", "test"), ("spread", "value"), ("sequence", "parts")}


def parenthesized_expression_unwrapped(s: Script) -> Iterator[Edit]:
    for node, parent, role in s.of("paren"):
        value, place = node.value, (parent.kind, role)
        heads = s(value).lstrip()[:9]
        opens = heads.startswith(("{", "function", "class", "async", "let"))
        if place == ("expression", "value"):
            free = not opens and value.kind != "sequence"
        elif place == ("function", "body"):
            free = not heads.startswith("{") and value.kind != "sequence"
        elif place in _FREE:
            free = value.kind != "sequence"
        else:
            under = parent.kind in ("binary", "conditional", "unary", "member", "index", "call")
            free = under and value.kind in ("name", "word", "string", "template", "member", "index", "call", "array") and not (role in ("callee", "value") and parent.kind in ("member", "index", "call") and _optional(value))
            if free and (opens or value.kind == "string" and parent.kind == "member"):
                free = False
        if free:
            before = s.source[node.start - 1 : node.start]
            yield node.start, node.end, (" " if before.isalnum() or before in "_$" else "") + s(value)


def _optional(node: Node) -> bool:
    while node.kind in ("member", "index", "call"):
        if node.maybe:
            return True
        node = node.callee if node.kind == "call" else node.value
    return False


def ts_runtime_erased(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("types", "import"):
        if node.kind == "types" or node.erased:
            yield node.start, node.end, ""


_JSX = frozenset("jsx jsxs jsxDEV _jsx _jsxs _jsxDEV".split())


def jsx_runtime_normalized(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("call"):
        callee = node.callee
        inner = bare(callee)
        if inner.kind == "sequence" and len(inner.parts) == 2 and inner.parts[0].kind == "number":
            inner = inner.parts[1]
        if inner.kind in ("member", "name") and inner.name in _JSX and s(callee) != "_jsx":
            yield callee.start, callee.end, "_jsx"


_WRAPPERS = frozenset("__toESM __toCommonJS __importDefault __importStar _interopRequireDefault _interopRequireWildcard _interopDefault".split())


def bundler_wrapper_unwrapped(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("call"):
        if node.callee.kind == "name" and node.callee.name in _WRAPPERS and node.args and node.args[0].kind != "spread" and all(a.kind in ("number", "word") or a.kind == "unary" for a in node.args[1:]):
            yield node.start, node.end, s.wrapped(node.args[0])


def helper_identity_inlined(s: Script) -> Iterator[Edit]:
    names: dict[str, int] = {}
    for node, _, _ in s.of("function"):
        if node.form == "declaration" and node.name:
            names[node.name] = names.get(node.name, 0) + 1
    for node, _, _ in s.of("function"):
        if node.form != "declaration" or names.get(node.name) != 1 or len(node.params) != 1 or node.params[0].kind != "name" or node.waits or node.yields:
            continue
        body = node.body.body
        if len(body) == 1 and body[0].kind == "return" and body[0].value is not None and body[0].value.kind == "name" and body[0].value.name == node.params[0].name and not _assigned(s, node.name):
            for call, _, _ in s.of("call"):
                if call.callee.kind == "name" and call.callee.name == node.name and len(call.args) == 1 and call.args[0].kind != "spread":
                    yield call.start, call.end, s.wrapped(call.args[0])


def _assigned(s: Script, name: str) -> bool:
    return any(n.left.kind == "name" and n.left.name == name for n, _, _ in s.of("assign")) or any(n.target.kind == "name" and n.target.name == name for n, _, _ in s.of("declarator")) or any(p.kind == "name" and p.name == name for n, _, _ in s.of("function") for p in n.params)


def export_boundary_normalized(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("export"):
        if node.origin is None:
            named = node.value is not None and (not node.default or node.value.kind in ("function", "class") and node.value.name)
            if node.value is None:
                yield node.start, node.end, ""
            elif named:
                yield node.start, node.value.start, ""


def commonjs_export_boundary_normalized(s: Script) -> Iterator[Edit]:
    for node, parent, _ in s.of("expression"):
        if parent is not s.tree or node.value.kind != "assign" or node.value.op != "=":
            continue
        left, right = node.value.left, node.value.right
        if left.kind != "member" or left.maybe:
            continue
        on_exports = s(left.value) in ("exports", "module.exports")
        if on_exports and right.kind == "function" and right.form == "expression" and right.name in (None, left.name) and not s.bound(left.name):
            open_at = s.source.index("(", right.start)
            yield node.start, node.end, f"{'async ' if right.waits else ''}function{'*' if right.yields else ''} {left.name}{s.source[open_at : right.end]}"
        elif on_exports and right.kind == "name" and right.name == left.name or s(left) == "module.exports" and right.kind == "object" and all(p.kind == "property" and p.short for p in right.parts):
            yield node.start, node.end, ""


def closure_boundary_aligned(s: Script) -> Iterator[Edit]:
    """A whole program in a closure without parameters is its body."""
    if len(s.tree.body) != 1 or s.tree.body[0].kind != "expression":
        return
    call = bare(s.tree.body[0].value)
    if call.kind != "call" or call.args:
        return
    f = bare(call.callee)
    if f.kind == "function" and not f.params and not f.waits and not f.yields and f.body.kind == "block" and f.name is None and not any(n.kind == "return" or n.kind == "word" and n.name == "this" for n, _, _ in walk(f.body)):
        yield s.tree.body[0].start, s.tree.body[0].end, _inner(s, f.body)


def boolean_undefined_canonicalised(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("unary"):
        if node.op == "!" and node.value.kind == "number" and node.value.text in ("0", "1"):
            yield node.start, node.end, "true" if node.value.text == "0" else "false"


def declarator_split(s: Script) -> Iterator[Edit]:
    for node, parent, role in s.of("variables"):
        if len(node.parts) > 1 and parent.kind in _LISTS and role == "body":
            yield node.start, node.end, " ".join(f"{node.word} {s(p)};" for p in node.parts)


def sequence_expression_split(s: Script) -> Iterator[Edit]:
    for node, parent, role in s.of("expression"):
        value = bare(node.value)
        if value.kind == "sequence" and parent.kind in _LISTS and role == "body":
            yield node.start, node.end, " ".join(f"{_headed(s, p)};" for p in value.parts)


def _headed(s: Script, node: Node) -> str:
    """An expression's text as a statement."""
    return f"({s(node)})" if s(node).startswith(("{", "function", "class", "let[", "async function")) else s(node)


def logical_short_circuit_expanded(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("expression"):
        value = bare(node.value)
        if value.kind == "binary" and value.op in ("&&", "||"):
            test = s(value.left) if value.op == "&&" else "!" + s.wrapped(value.left)
            yield node.start, node.end, f"if ({test}) {_headed(s, bare(value.right) if value.right.kind == 'paren' and bare(value.right).kind != 'sequence' else value.right)};"


def conditional_negation_flipped(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("conditional"):
        test = bare(node.test)
        if test.kind == "unary" and test.op == "!" and not (bare(test.value).kind == "unary" and bare(test.value).op == "!"):
            yield node.start, node.end, f"{s.wrapped(bare(test.value))} ? {s(node.no)} : {s(node.yes)}"


def conditional_statement_expanded(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("expression"):
        value = bare(node.value)
        if value.kind == "conditional":
            yield node.start, node.end, f"if ({s(bare(value.test))}) {{ {_headed(s, value.yes)}; }} else {{ {_headed(s, value.no)}; }}"


def return_conditional_expanded(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("return"):
        if node.value is not None and bare(node.value).kind == "conditional":
            value = bare(node.value)
            yield node.start, node.end, f"if ({s(bare(value.test))}) {{ return {s(value.yes)}; }} else {{ return {s(value.no)}; }}"


def computed_to_static_member(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("index"):
        if node.key.kind == "string" and _NAME.match(node.key.text[1:-1]) and node.value.kind != "number":
            yield node.value.end, node.end, ("?." if node.maybe else ".") + node.key.text[1:-1]


def arrow_body_blocked(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("function"):
        if node.form == "arrow" and node.body.kind != "block":
            value = bare(node.body)
            yield node.body.start, node.body.end, f"{{ return {s(value) if value.kind != 'sequence' else s(node.body)}; }}"


_COMPOUND = frozenset("+ - * / % ** << >> >>> & | ^".split())


def _settled(node: Node) -> bool:
    """Whether reading a place twice is reading it once: names and static members of names."""
    while node.kind == "member" and not node.maybe:
        node = node.value
    return node.kind == "name" or node.kind == "word" and node.name == "this"


def _compound(s: Script, ops: frozenset) -> Iterator[Edit]:
    for node, _, _ in s.of("assign"):
        right = bare(node.right)
        if node.op == "=" and right.kind == "binary" and right.op in ops and _settled(node.left) and s(right.left) == s(node.left):
            yield node.start, node.end, f"{s(node.left)} {right.op}= {s(right.right)}"


def compound_assignment_canonical(s: Script) -> Iterator[Edit]:
    return _compound(s, _COMPOUND)


def logical_compound_assignment_canonical(s: Script) -> Iterator[Edit]:
    return _compound(s, frozenset(("||", "&&", "??")))


def if_return_else_flattened(s: Script) -> Iterator[Edit]:
    for node, parent, role in s.of("if"):
        if node.other is None or parent.kind not in _LISTS or role != "body" or not _leaves(node.then):
            continue
        scoped = node.other.kind == "block" and any(x.kind in ("function", "class") or x.kind == "variables" and x.word != "var" for x in node.other.body)
        if not scoped or parent.body[-1] is node and parent.kind != "case":
            yield node.then.end, node.end, " " + _inner(s, node.other)


_NEGATED = {"===": "!==", "!==": "===", "==": "!=", "!=": "=="}


def equality_negation_flattened(s: Script) -> Iterator[Edit]:
    for node, parent, _ in s.of("unary"):
        value = bare(node.value)
        if node.op == "!" and node.value.kind == "paren" and value.kind == "binary" and value.op in _NEGATED:
            new = f"{s(value.left)} {_NEGATED[value.op]} {s(value.right)}"
            yield node.start, node.end, f"({new})" if parent.kind in ("binary", "unary", "member", "call") else new


_MIRRORED = {"===": "===", "!==": "!==", "==": "==", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _constant(node: Node) -> bool:
    return node.kind in ("string", "number") or node.kind == "word" and node.name in ("null", "true", "false") or node.kind == "name" and node.name == "undefined"


def relational_operand_canonicalised(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("binary"):
        if node.op in _MIRRORED and _constant(node.left) and not _constant(node.right) and node.right.kind != "binary":
            yield node.start, node.end, f"{s(node.right)} {_MIRRORED[node.op]} {s(node.left)}"


def constant_string_concat_folded(s: Script) -> Iterator[Edit]:
    for node, parent, _ in s.of("binary"):
        a, b = node.left, node.right
        if node.op != "+" or b.kind != "string":
            continue
        if a.kind == "string" and a.text[0] not in b.text[1:-1] and (b.text[0] == a.text[0] or "\\" not in b.text):
            yield node.start, node.end, a.text[:-1] + b.text[1:-1] + a.text[0]


def logical_not_chain_flattened(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("unary"):
        if node.op == "!" and node.value.kind == "unary" and node.value.op == "!" and node.value.value.kind == "unary" and node.value.value.op == "!":
            yield node.start, node.end, s(node.value.value)


def template_no_substitution_lowered(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("template"):
        text = node.text[1:-1]
        if not re.search(r"[\\\n\r\"]|\$\{", text):
            yield node.start, node.end, f'"{text}"'


def infinite_for_to_while(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("for"):
        if node.init is None and node.test is None and node.step is None:
            yield node.start, node.end, f"while (true) {s(node.body)}"


def for_to_while_finite(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("for"):
        if node.init is None and node.step is None and node.test is not None:
            yield node.start, node.end, f"while ({s(node.test)}) {s(node.body)}"


_BOOLEAN = frozenset("=== !== == != < > <= >= in instanceof".split())


def conditional_boolean_coerced(s: Script) -> Iterator[Edit]:
    for node, parent, _ in s.of("conditional"):
        words = (s(bare(node.yes)), s(bare(node.no)))
        test = bare(node.test)
        if words == ("true", "false"):
            boolean = test.kind == "binary" and test.op in _BOOLEAN or test.kind == "unary" and test.op == "!"
            yield node.start, node.end, s(test) if boolean and parent.kind not in ("binary", "unary", "member") else "!!" + s.wrapped(test)
        elif words == ("false", "true"):
            yield node.start, node.end, "!" + s.wrapped(test)


def trailing_return_void_removed(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("function"):
        if node.body.kind == "block" and node.body.body and node.body.body[-1].kind == "return" and node.body.body[-1].value is None:
            yield node.body.body[-1].start, node.body.body[-1].end, ""


def void_zero_to_undefined(s: Script) -> Iterator[Edit]:
    found = [n for n, _, _ in s.of("unary") if n.op == "void" and n.value.kind == "number"]
    if found and not s.bound("undefined"):
        yield from ((n.start, n.end, "undefined") for n in found)


def boolean_call_to_double_not(s: Script) -> Iterator[Edit]:
    found = [n for n, _, _ in s.of("call") if n.callee.kind == "name" and n.callee.name == "Boolean" and len(n.args) == 1 and n.args[0].kind != "spread"]
    if found and not s.bound("Boolean"):
        yield from ((n.start, n.end, "!!" + s.wrapped(n.args[0])) for n in found)


def _nothing(s: Script, node: Node, op: str) -> tuple[str, str] | None:
    """(what, null or undefined) of a comparison with one of them."""
    node = bare(node)
    if node.kind != "binary" or node.op != op:
        return None
    for a, b in ((node.left, node.right), (node.right, node.left)):
        if _settled(a) and not s.undefined(a):
            if b.kind == "word" and b.name == "null":
                return s(a), "null"
            if s.undefined(b):
                return s(a), "undefined"
    return None


def nullish_equality_compacted(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("binary"):
        for op, short, join in (("===", "==", "||"), ("!==", "!=", "&&")):
            if node.op == join and (a := _nothing(s, node.left, op)) and (b := _nothing(s, node.right, op)) and a[0] == b[0] and a[1] != b[1] and not s.bound("undefined"):
                yield node.start, node.end, f"{a[0]} {short} null"


def typeof_local_undefined_guarded(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("binary"):
        if node.op in _NEGATED and node.left.kind == "unary" and node.left.op == "typeof" and node.left.value.kind == "name" and node.right.kind == "string" and node.right.text[1:-1] == "undefined" and s.bound(node.left.value.name) and not s.bound("undefined"):
            yield node.start, node.end, f"{node.left.value.name} {node.op[0]}== undefined"


def nullish_assignment_compacted(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("if"):
        then = node.then.body[0] if node.then.kind == "block" and len(node.then.body) == 1 else node.then
        if node.other is not None or then.kind != "expression" or then.value.kind != "assign" or then.value.op != "=":
            continue
        found = _nothing(s, node.test, "==")
        if found and s(then.value.left) == found[0]:
            yield node.start, node.end, f"{found[0]} ??= {s(then.value.right)};"


def empty_else_block_removed(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("if"):
        if node.other is not None and (node.other.kind == "empty" or node.other.kind == "block" and not node.other.body and "/" not in s(node.other)):
            yield s.source.index("else", node.then.end), node.end, ""


def statement_body_blocked(s: Script) -> Iterator[Edit]:
    for node, _, _ in s.of("if", "while", "for", "foreach", "do", "with"):
        for role in ("then", "other", "body"):
            child = node.fields.get(role)
            if child is not None and child.kind not in ("block", "empty") and not (role == "other" and child.kind == "if") and not (child.kind == "variables" or child.kind == "function"):
                before = s.source[child.start - 1 : child.start]
                yield child.start, child.end, (" " if before.isalnum() else "") + f"{{ {s(child)} }}"


#: In the order in which they run; their names are those that alternates are known by (fixed values).
PASSES: list[Callable[[Script], Iterator[Edit]]] = [
    parenthesized_expression_unwrapped, ts_runtime_erased, jsx_runtime_normalized, bundler_wrapper_unwrapped, helper_identity_inlined, export_boundary_normalized,
    commonjs_export_boundary_normalized, closure_boundary_aligned, boolean_undefined_canonicalised, declarator_split, sequence_expression_split, logical_short_circuit_expanded,
    conditional_negation_flipped, conditional_statement_expanded, return_conditional_expanded, computed_to_static_member, arrow_body_blocked, compound_assignment_canonical,
    logical_compound_assignment_canonical, if_return_else_flattened, equality_negation_flattened, relational_operand_canonicalised, constant_string_concat_folded, logical_not_chain_flattened,
    template_no_substitution_lowered, infinite_for_to_while, for_to_while_finite, conditional_boolean_coerced, trailing_return_void_removed, void_zero_to_undefined,
    boolean_call_to_double_not, nullish_equality_compacted, typeof_local_undefined_guarded, nullish_assignment_compacted, empty_else_block_removed, statement_body_blocked,
]


def applied(source: str, edits: list[Edit]) -> str:
    """The text after all edits that don't overlap, inner ones first; the others come up again."""
    chosen: list[Edit] = []
    taken = -1
    # By their ends: of nested edits the inner one ends first.
    for start, end, new in sorted(edits, key=lambda e: (e[1], -e[0])):
        if start >= taken:
            chosen.append((start, end, new))
            taken = end
    out, at = [], 0
    for start, end, new in chosen:
        out += [source[at:start], new]
        at = end
    return "".join([*out, source[at:]])


def normalized(source: str) -> tuple[str, list[str]]:
    """The text after all passes to a fixed point, and the passes that changed it."""
    used: list[str] = []
    try:
        script = Script(source)
    except Unparsed:
        return source, used
    for _ in range(ROUNDS):
        before = source
        for rewrite in PASSES:
            for _ in range(ROUNDS):
                edits = list(rewrite(script))
                if not edits:
                    break
                after = applied(source, edits)
                try:
                    script = Script(after)
                except Unparsed:
                    # What a pass would break is left to the others.
                    break
                source = after
                if rewrite.__name__ not in used:
                    used.append(rewrite.__name__)
        if source == before:
            return source, used
    raise RuntimeError("the passes do not settle on a text")
