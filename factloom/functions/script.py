"""A lexer and a parser of script text (ECMAScript 2022 without JSX), in one pass over the text each.

lex() tells strings, templates and regular expressions from code; parse() makes a tree whose nodes know where they stand in the text, so that
rewrites can leave all else as it is. A template is one token whatever its substitutions hold. Text that doesn't parse raises Unparsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Unparsed(ValueError):
    pass


class Token(NamedTuple):
    kind: str  # name, number, string, template, regex, mark or end
    text: str
    start: int
    end: int
    fresh: bool  # whether a line ends before it


_MARKS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> **".split()
_SPACE = re.compile(r"(?:[^\S\n]|//[^\n]*|/\*.*?\*/|\n|<!--[^\n]*|/\*.*\Z)+", re.DOTALL)
_PLAIN = re.compile(
    r"(?P<name>#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<mark>""" + "|".join(map(re.escape, _MARKS)) + r"|.)",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
#: After these words an expression begins.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def _template(source: str, at: int) -> int:
    """Where the template that begins at `at` ends, with templates and strings inside its substitutions."""
    k, n = at + 1, len(source)
    while k < n:
        c = source[k]
        if c == "\\":
            k += 2
        elif c == "`":
            return k + 1
        elif c == "$" and source[k + 1 : k + 2] == "{":
            depth, k = 1, k + 2
            while k < n and depth:
                c = source[k]
                if c == "`":
                    k = _template(source, k)
                    continue
                if c in "\"'":
                    m = _PLAIN.match(source, k)
                    k = m.end() if m and m.lastgroup == "string" else k + 1
                    continue
                depth += (c == "{") - (c == "}")
                k += 1
        else:
            k += 1
    return n


def lex(source: str) -> list[Token]:
    out: list[Token] = []
    at, n, fresh = 0, len(source), False
    while at < n:
        if m := _SPACE.match(source, at):
            fresh = fresh or "\n" in m[0]
            at = m.end()
            continue
        c = source[at]
        if c == "`":
            kind, end = "template", _template(source, at)
        elif c == "/" and _value_follows(out) and (m := _REGEX.match(source, at)):
            kind, end = "regex", m.end()
        else:
            m = _PLAIN.match(source, at)
            kind, end = m.lastgroup, m.end()
            if m[0] == "?." and source[end : end + 1].isdigit():
                kind, end = "mark", at + 1
        out.append(Token(kind, source[at:end], at, end, fresh))
        at, fresh = end, False
    return out


def _value_follows(before: list[Token]) -> bool:
    """Whether a value may stand here, so that / begins a regular expression."""
    if not before:
        return True
    last = before[-1]
    if last.kind == "name":
        return last.text in _BEFORE_VALUE
    return last.kind == "mark" and last.text not in (")", "]", "++", "--")


class Node:
    """A piece of the tree: what it is, from where to where, and its fields."""

    __slots__ = ("kind", "start", "end", "fields")

    def __init__(self, kind: str, start: int, end: int, **fields):
        self.kind, self.start, self.end, self.fields = kind, start, end, fields

    def __getattr__(self, name: str):
        try:
            return self.fields[name]
        except KeyError:
            raise AttributeError(name) from None

    def upto(self, parser: Parser) -> Node:
        self.end = parser.last
        return self

    def children(self) -> Iterator[tuple[str, Node]]:
        for role, value in self.fields.items():
            if isinstance(value, Node):
                yield role, value
            elif isinstance(value, list):
                for x in value:
                    if isinstance(x, Node):
                        yield role, x


def walk(node: Node) -> Iterator[tuple[Node, Node | None, str]]:
    """(node, parent, role) of a tree, parents first, without recursion."""
    stack: list[tuple[Node, Node | None, str]] = [(node, None, "")]
    while stack:
        here = stack.pop()
        yield here
        stack += [(child, here[0], role) for role, child in reversed(list(here[0].children()))]


BINARY = {op: level for level, ops in enumerate(("??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= in instanceof", "<< >> >>>", "+ -", "* / %", "**"), 1) for op in ops.split()}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_UNARY = frozenset("! ~ + - typeof void delete".split())


class Parser:
    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, lex(source), 0
        self.tokens.append(Token("end", "", len(source), len(source), True))
        self.closing = self._brackets()

    def _brackets(self) -> dict[int, int]:
        stack, out = [], {}
        for i, t in enumerate(self.tokens):
            if t.kind == "mark":
                if t.text in "([{":
                    stack.append((t.text, i))
                elif t.text in ")]}":
                    if not stack or "([{".index(stack[-1][0]) != ")]}".index(t.text):
                        raise Unparsed(f"unmatched {t.text} at {t.start}")
                    out[stack.pop()[1]] = i
        if stack:
            raise Unparsed(f"{stack[-1][0]} is never closed")
        return out

    @property
    def tok(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def sees(self, *texts: str) -> bool:
        return self.tok.kind in ("mark", "name") and self.tok.text in texts

    def take(self, text: str | None = None) -> Token:
        t = self.tok
        if text is not None and not self.sees(text) or t.kind == "end":
            raise Unparsed(f"{text or 'more'} expected at {t.start}")
        self.at += 1
        return t

    def takes(self, text: str) -> bool:
        if self.sees(text):
            self.at += 1
            return True
        return False

    @property
    def last(self) -> int:
        return self.tokens[self.at - 1].end if self.at else 0

    def ends(self) -> None:
        """The end of a statement: a semicolon, or where one may be left out."""
        if not self.takes(";") and not (self.sees("}") or self.tok.kind == "end" or self.tok.fresh):
            raise Unparsed(f"; expected at {self.tok.start}")

    # Statements

    def program(self) -> Node:
        body = []
        while self.tok.kind != "end":
            body.append(self.statement())
        return Node("program", 0, len(self.source), body=body)

    def block(self) -> Node:
        start, body = self.take("{").start, []
        while not self.sees("}"):
            body.append(self.statement())
        self.take("}")
        return Node("block", start, self.last, body=body)

    def statement(self) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind == "mark":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.take()
                return Node("empty", start, self.last)
        elif t.kind == "name":
            after = self.ahead()
            method = getattr(self, f"_{t.text}", None) if t.text in STATEMENTS else None
            if method:
                return method(start)
            if t.text in ("var", "const") or t.text == "let" and (after.kind == "name" or after.text in ("[", "{")):
                node = self.variables()
                self.ends()
                node.end = self.last
                return node
            if t.text == "function" or t.text == "async" and after.text == "function" and not after.fresh:
                return self.function("declaration")
            if t.text == "class":
                return self.class_()
            if t.text in ("import", "export") and not (t.text == "import" and after.text in ("(", ".")):
                return self.import_() if t.text == "import" else self.export()
            if t.text in ("interface", "type", "declare") and after.kind == "name" and not after.fresh:
                return self.types()
            if after.text == ":" and after.kind == "mark":
                self.at += 2
                return self._labeled(start, t.text)
        value = self.expression()
        self.ends()
        return Node("expression", start, self.last, value=value)

    def _labeled(self, start: int, label: str) -> Node:
        body = self.statement()
        return Node("labeled", start, self.last, label=label, body=body)

    def variables(self, no_in: bool = False) -> Node:
        t, parts = self.take(), []
        while True:
            start, target, init = self.tok.start, self.target(), None
            if self.takes("="):
                init = self.assign(no_in)
            parts.append(Node("declarator", start, self.last, target=target, init=init))
            if not self.takes(","):
                return Node("variables", t.start, self.last, word=t.text, parts=parts)

    def target(self) -> Node:
        if self.sees("[", "{"):
            return self.primary()
        t = self.take()
        if t.kind != "name":
            raise Unparsed(f"a name expected at {t.start}")
        return Node("name", t.start, t.end, name=t.text)

    def test(self) -> Node:
        self.take("(")
        value = self.expression()
        self.take(")")
        return value

    def _if(self, start: int) -> Node:
        self.take()
        test, then, other = self.test(), self.statement(), None
        if self.takes("else"):
            other = self.statement()
        return Node("if", start, self.last, test=test, then=then, other=other)

    def _while(self, start: int) -> Node:
        self.take()
        test = self.test()
        body = self.statement()
        return Node("while", start, self.last, test=test, body=body)

    def _do(self, start: int) -> Node:
        self.take()
        body = self.statement()
        self.take("while")
        test = self.test()
        self.takes(";")
        return Node("do", start, self.last, body=body, test=test)

    def _for(self, start: int) -> Node:
        self.take()
        waits = self.takes("await")
        self.take("(")
        init = None
        if not self.sees(";"):
            if self.sees("var", "const") or self.sees("let") and (self.ahead().kind == "name" or self.ahead().text in ("[", "{")):
                init = self.variables(no_in=True)
            else:
                init = self.expression(no_in=True)
            if self.sees("of", "in"):
                way = self.take().text
                source = self.expression() if way == "in" else self.assign()
                self.take(")")
                body = self.statement()
                return Node("foreach", start, self.last, way=way, waits=waits, target=init, source=source, body=body)
        self.take(";")
        test = None if self.sees(";") else self.expression()
        self.take(";")
        step = None if self.sees(")") else self.expression()
        self.take(")")
        body = self.statement()
        return Node("for", start, self.last, init=init, test=test, step=step, body=body)

    def _leave(self, start: int, kind: str, valued: bool) -> Node:
        self.take()
        value = None
        if valued and not (self.sees(";", "}") or self.tok.kind == "end" or self.tok.fresh):
            value = self.expression()
        self.ends()
        return Node(kind, start, self.last, value=value)

    def _return(self, start: int) -> Node:
        return self._leave(start, "return", True)

    def _throw(self, start: int) -> Node:
        return self._leave(start, "throw", True)

    def _break(self, start: int) -> Node:
        return self._leave(start, "break", True)

    def _continue(self, start: int) -> Node:
        return self._leave(start, "continue", True)

    def _debugger(self, start: int) -> Node:
        return self._leave(start, "debugger", False)

    def _with(self, start: int) -> Node:
        self.take()
        test = self.test()
        body = self.statement()
        return Node("with", start, self.last, test=test, body=body)

    def _switch(self, start: int) -> Node:
        self.take()
        test, cases = self.test(), []
        self.take("{")
        while not self.takes("}"):
            at, value, body = self.tok.start, None, []
            if self.takes("case"):
                value = self.expression()
            else:
                self.take("default")
            self.take(":")
            while not self.sees("case", "default", "}"):
                body.append(self.statement())
            cases.append(Node("case", at, self.last, value=value, body=body))
        return Node("switch", start, self.last, test=test, cases=cases)

    def _try(self, start: int) -> Node:
        self.take()
        body, target, handler, final = self.block(), None, None, None
        if self.takes("catch"):
            if self.takes("("):
                target = self.target()
                self.take(")")
            handler = self.block()
        if self.takes("finally"):
            final = self.block()
        return Node("try", start, self.last, body=body, target=target, handler=handler, final=final)

    def names(self) -> list[tuple[str, str]]:
        """(outer, inner) names in braces."""
        out = []
        self.take("{")
        while not self.takes("}"):
            one = self.take().text
            out.append((one, self.take().text if self.takes("as") else one))
            if not self.sees("}"):
                self.take(",")
        return out

    def import_(self) -> Node:
        start, names, erased = self.take().start, [], False
        if self.sees("type") and self.ahead().text != "from":
            erased = bool(self.take())
        if self.tok.kind != "string":
            if self.tok.kind == "name":
                names.append(("default", self.take().text))
                self.takes(",")
            if self.takes("*"):
                self.take("as")
                names.append(("*", self.take().text))
            elif self.sees("{"):
                names += self.names()
            self.take("from")
        origin = self.take().text
        self.ends()
        return Node("import", start, self.last, names=names, origin=origin, erased=erased)

    def export(self) -> Node:
        start, origin, names, value, default = self.take().start, None, [], None, False
        if self.takes("*"):
            if self.takes("as"):
                names.append(("*", self.take().text))
            self.take("from")
            origin = self.take().text
            self.ends()
        elif self.sees("{"):
            names = self.names()
            if self.takes("from"):
                origin = self.take().text
            self.ends()
        elif self.takes("default"):
            default = True
            if self.sees("function", "class") or self.sees("async") and self.ahead().text == "function":
                value = self.class_() if self.sees("class") else self.function("declaration")
            else:
                value = self.assign()
                self.ends()
        else:
            value = self.statement()
        return Node("export", start, self.last, origin=origin, names=names, value=value, default=default)

    def types(self) -> Node:
        """A declaration that only holds types."""
        start = self.tok.start
        self.takes("declare")
        word = self.take().text
        if word not in ("interface", "type"):
            raise Unparsed(f"{word} is not known to be a type")
        while word == "interface" and not self.sees("{"):
            self.take()
        first = self.at
        while True:
            if self.at in self.closing:
                self.at = self.closing[self.at] + 1
                if word == "interface":
                    break
            elif self.tok.kind == "end" or self.sees(";") or self.tok.fresh and self.at > first and not self.sees("|", "&"):
                self.takes(";")
                break
            else:
                self.at += 1
        return Node("types", start, self.last)

    # Functions and classes

    def function(self, form: str) -> Node:
        start = self.tok.start
        waits = self.takes("async")
        self.take("function")
        yields = self.takes("*")
        name = None if self.sees("(") else self.take().text
        params = self.params()
        return Node("function", start, 0, form=form, name=name, params=params, body=self.block(), waits=waits, yields=yields).upto(self)

    def params(self) -> list[Node]:
        self.take("(")
        out = []
        while not self.takes(")"):
            out.append(self.element())
            if not self.sees(")"):
                self.take(",")
        return out

    def element(self) -> Node:
        if self.sees("..."):
            start = self.take().start
            value = self.assign()
            return Node("spread", start, self.last, value=value)
        return self.assign()

    def class_(self) -> Node:
        start, base, members = self.take("class").start, None, []
        name = None if self.sees("extends", "{") else self.take().text
        if self.takes("extends"):
            base = self.postfix()
        self.take("{")
        while not self.takes("}"):
            if not self.takes(";"):
                members.append(self.member(True))
        return Node("class", start, self.last, name=name, base=base, members=members)

    def member(self, of_class: bool) -> Node:
        """A property, method or field."""
        start, words = self.tok.start, []
        if not of_class and self.sees("..."):
            return self.element()
        while self.sees("static", "async", "get", "set", "*") and self.ahead().text not in ("(", ",", ":", "=", "}", ";"):
            if words and self.ahead(0).fresh:
                break
            words.append(self.take().text)
            if words == ["static"] and self.sees("{"):
                return Node("static", start, 0, body=self.block()).upto(self)
        key, computed = self.tok, self.sees("[")
        if computed:
            self.take()
            name = self.assign()
            self.take("]")
        else:
            self.take()
            if key.kind not in ("name", "string", "number"):
                raise Unparsed(f"a key expected at {key.start}")
            name = Node("key", key.start, key.end, name=key.text.strip("\"'") if key.kind == "string" else key.text)
        if self.sees("("):
            params = self.params()
            body = self.block()
            value = Node("function", start, self.last, form="method", name=None if computed else name.name, params=params, body=body, waits="async" in words, yields="*" in words)
            return Node("property", start, self.last, key=name, computed=computed, value=value, words=words, short=False)
        value, short = None, False
        if of_class:
            if self.takes("="):
                value = self.assign()
            self.ends()
        elif self.takes(":"):
            value = self.assign()
        else:
            short = True
            if key.kind != "name":
                raise Unparsed(f": expected at {self.tok.start}")
            value = Node("name", key.start, key.end, name=key.text)
            if self.takes("="):
                other = self.assign()
                value = Node("assign", key.start, self.last, op="=", left=value, right=other)
        return Node("property", start, self.last, key=name, computed=computed, value=value, words=words, short=short)

    # Expressions

    def expression(self, no_in: bool = False) -> Node:
        first = self.assign(no_in)
        if not self.sees(","):
            return first
        parts = [first]
        while self.takes(","):
            parts.append(self.assign(no_in))
        return Node("sequence", first.start, self.last, parts=parts)

    def arrow(self) -> Node | None:
        """An arrow function, if one begins here."""
        start, at = self.tok.start, self.at
        waits = self.sees("async") and not self.ahead().fresh and (self.ahead().kind == "name" or self.ahead().text == "(")
        k = at + waits
        t = self.tokens[k]
        end = k if t.kind == "name" else self.closing.get(k) if t.text == "(" else None
        if end is None or end + 1 >= len(self.tokens) or self.tokens[end + 1].text != "=>":
            return None
        self.at = k
        params = self.params() if t.text == "(" else [self.target()]
        self.take("=>")
        body = self.block() if self.sees("{") else self.assign()
        return Node("function", start, self.last, form="arrow", name=None, params=params, body=body, waits=waits, yields=False)

    def assign(self, no_in: bool = False) -> Node:
        t = self.tok
        if (t.kind == "name" or t.text == "(" and t.kind == "mark") and (found := self.arrow()):
            return found
        if self.sees("yield") and not (self.ahead().kind == "mark" and self.ahead().text in ("=", ".")):
            self.take()
            self.takes("*")
            value = None if self.sees(")", "]", "}", ",", ";", ":") or self.tok.kind == "end" or self.tok.fresh else self.assign(no_in)
            return Node("yield", t.start, self.last, value=value)
        left = self.conditional(no_in)
        if self.tok.kind == "mark" and self.tok.text in ASSIGN:
            if left.kind not in ("name", "member", "index", "array", "object", "paren"):
                raise Unparsed(f"nothing to assign to at {left.start}")
            op = self.take().text
            right = self.assign(no_in)
            return Node("assign", left.start, self.last, op=op, left=left, right=right)
        return left

    def conditional(self, no_in: bool) -> Node:
        test = self.binary(1, no_in)
        if not self.sees("?"):
            return test
        self.take()
        yes = self.assign()
        self.take(":")
        no = self.assign(no_in)
        return Node("conditional", test.start, self.last, test=test, yes=yes, no=no)

    def binary(self, least: int, no_in: bool) -> Node:
        left = self.unary()
        while True:
            t = self.tok
            level = BINARY.get(t.text, 0) if t.kind in ("mark", "name") else 0
            if level < least or t.text == "in" and no_in:
                return left
            self.take()
            right = self.binary(level if t.text == "**" else level + 1, no_in)
            left = Node("binary", left.start, self.last, op=t.text, left=left, right=right)

    def unary(self) -> Node:
        t = self.tok
        if t.kind in ("mark", "name"):
            if t.text in _UNARY or t.text == "await" and not (self.ahead().kind == "mark" and self.ahead().text not in ("(", "[", "{", "!", "~", "+", "-")):
                self.take()
                value = self.unary()
                return Node("unary", t.start, self.last, op=t.text, value=value)
            if t.text in ("++", "--"):
                self.take()
                value = self.unary()
                return Node("update", t.start, self.last, op=t.text, value=value, before=True)
        value = self.postfix()
        if self.sees("++", "--") and not self.tok.fresh:
            op = self.take().text
            return Node("update", value.start, self.last, op=op, value=value, before=False)
        return value

    def arguments(self) -> list[Node]:
        return self.params()

    def postfix(self, calls: bool = True) -> Node:
        value = self.new() if self.sees("new") else self.primary()
        while True:
            if self.sees("."):
                self.take()
                t = self.take()
                if t.kind != "name":
                    raise Unparsed(f"a name expected at {t.start}")
                value = Node("member", value.start, t.end, value=value, name=t.text, maybe=False)
            elif self.sees("?.") and calls:
                self.take()
                if self.sees("("):
                    args = self.arguments()
                    value = Node("call", value.start, self.last, callee=value, args=args, maybe=True)
                elif self.sees("["):
                    self.take()
                    key = self.expression()
                    self.take("]")
                    value = Node("index", value.start, self.last, value=value, key=key, maybe=True)
                else:
                    t = self.take()
                    value = Node("member", value.start, t.end, value=value, name=t.text, maybe=True)
            elif self.sees("["):
                self.take()
                key = self.expression()
                self.take("]")
                value = Node("index", value.start, self.last, value=value, key=key, maybe=False)
            elif self.sees("(") and calls:
                args = self.arguments()
                value = Node("call", value.start, self.last, callee=value, args=args, maybe=False)
            elif self.tok.kind == "template":
                t = self.take()
                value = Node("tagged", value.start, t.end, value=value, text=t.text)
            else:
                return value

    def new(self) -> Node:
        start = self.take("new").start
        if self.takes("."):
            self.take("target")
            return Node("word", start, self.last, name="new.target")
        callee = self.postfix(calls=False)
        args = self.arguments() if self.sees("(") else []
        return Node("new", start, self.last, callee=callee, args=args)

    def primary(self) -> Node:
        t = self.tok
        if t.kind in ("number", "string", "template", "regex"):
            self.take()
            return Node(t.kind, t.start, t.end, text=t.text)
        if t.kind == "name":
            if t.text == "function" or t.text == "async" and self.ahead().text == "function" and not self.ahead().fresh:
                return self.function("expression")
            if t.text == "class":
                return self.class_()
            if t.text in _RESERVED:
                raise Unparsed(f"{t.text} at {t.start}")
            self.take()
            return Node("word" if t.text in ("this", "super", "null", "true", "false", "import") else "name", t.start, t.end, name=t.text)
        if self.sees("("):
            self.take()
            value = self.expression()
            self.take(")")
            return Node("paren", t.start, self.last, value=value)
        if self.sees("["):
            self.take()
            parts = []
            while not self.takes("]"):
                if self.takes(","):
                    continue
                parts.append(self.element())
                if not self.sees("]"):
                    self.take(",")
            return Node("array", t.start, self.last, parts=parts)
        if self.sees("{"):
            self.take()
            parts = []
            while not self.takes("}"):
                parts.append(self.member(False))
                if not self.sees("}"):
                    self.take(",")
            return Node("object", t.start, self.last, parts=parts)
        raise Unparsed(f"{t.text or 'the end'} at {t.start}")


STATEMENTS = frozenset("if while do for return throw break continue debugger with switch try".split())
_RESERVED = frozenset("if else while do for return throw break continue switch case default try catch finally var const in instanceof typeof void delete new extends export with".split())


def parse(source: str) -> Node:
    """The tree of a text; nesting deeper than the interpreter bears counts as unparseable."""
    try:
        return Parser(source).program()
    except RecursionError:
        raise Unparsed("nested too deeply") from None
