"""A compiler for chat templates.

Language: text; `{{ expression }}`; `{% for x in list %} .. {% endfor %}` (with `loop.first`, `loop.last`,
`loop.index0`); `{% if %} .. {% elif %} .. {% else %} .. {% endif %}`; `{% set name = expression %}`;
`{% generation %} .. {% endgeneration %}`, which puts its output under the loss mask. Expressions: strings,
integers, true, false, none, names, `a.b`, `a['b']`, `a[0]`, `+`, `==`, `!=`, `and`, `or`, `not`, parentheses
and filters `| escape`, `| trim`, `| upper`, `| lower`, `| default('x')`.

A template sees the mappings, lists and scalars that it is given and nothing else: names and keys are
looked up in mappings only, never as attributes of Python objects; there are no calls but the filters.
It is parsed into a syntax tree, constant parts are folded (and neighbouring texts joined), and the
tree becomes nested Python closures; no source text is ever evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

Scope = dict[str, Any]
Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


class Stream:
    """Items that a loop reads once, one after the other, without holding them."""

    def __init__(self, items: Iterable):
        self.items = items

    def __iter__(self) -> Iterator:
        return iter(self.items)


# --- syntax tree -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    of: Any


@dataclass(frozen=True)
class Set:
    name: str
    of: Any


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body) each; the condition of else is Const(True)


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing -----------------------------------------------------------------------------------

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<int>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>==|!=|[-+.\[\](),|]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in"}
_CONSTANTS = {"true": True, "false": False, "none": None}


def _tokens(text: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"unexpected {text[at:at + 10]!r}")
        kind, at = m.lastgroup, m.end()
        value = m[kind]
        if kind == "int":
            out.append(("const", int(value)))
        elif kind == "string":
            out.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), value[1:-1], flags=re.S)))
        elif kind == "name" and value in _CONSTANTS:
            out.append(("const", _CONSTANTS[value]))
        elif kind == "name" and value in _WORDS:
            out.append(("op", value))
        else:
            out.append((kind, value))
    return out


class _Expression:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops

    def take(self, kind: str, value: Any = None) -> Any:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or (value is not None and self.tokens[self.at][1] != value):
            raise TemplateError(f"expected {value or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Any:
        found = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def _chain(self, ops: tuple[str, ...], below: Callable[[], Any]) -> Any:
        left = below()
        while self.peek(*ops):
            left = Binary(self.take("op"), left, below())
        return left

    def either(self) -> Any:
        return self._chain(("or",), self.both)

    def both(self) -> Any:
        return self._chain(("and",), self.inverse)

    def inverse(self) -> Any:
        if self.peek("not"):
            self.take("op")
            return Not(self.inverse())
        return self._chain(("==", "!="), self.total)

    def total(self) -> Any:
        return self._chain(("+",), self.filtered)

    def filtered(self) -> Any:
        found = self.atom()
        while self.peek(".", "[", "|"):
            op = self.take("op")
            if op == ".":
                found = Item(found, Const(self.take("name")))
            elif op == "[":
                found = Item(found, self.either())
                self.take("op", "]")
            else:
                name, args = self.take("name"), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                if self.peek("("):
                    self.take("op")
                    while not self.peek(")"):
                        args.append(self.either())
                        if not self.peek(")"):
                            self.take("op", ",")
                    self.take("op")
                found = Filter(name, found, tuple(args))
        return found

    def atom(self) -> Any:
        if self.peek("("):
            self.take("op")
            found = self.either()
            self.take("op", ")")
            return found
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("const", "name"):
            kind, value = self.tokens[self.at]
            self.at += 1
            return Const(value) if kind == "const" else Name(value)
        raise TemplateError("expected a value")


def parse(source: str) -> tuple:
    parts = [x for x in _PARTS.split(source) if x]
    at = 0

    def body(until: tuple[str, ...]) -> tuple[tuple, str, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Print(_Expression(part[2:-2]).whole()))
            elif part.startswith("{#"):
                continue
            elif part.startswith("{%"):
                words = part[2:-2].strip("-").strip()
                word, _, rest = words.partition(" ")
                if word in until:
                    return tuple(out), word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad loop: {rest}")
                    inner, _, _ = body(("endfor",))
                    out.append(For(m[1], _Expression(m[2]).whole(), inner))
                elif word == "if":
                    arms, condition = [], _Expression(rest).whole()
                    while True:
                        inner, end, more = body(("elif", "else", "endif"))
                        arms.append((condition, inner))
                        if end == "endif":
                            break
                        condition = _Expression(more).whole() if end == "elif" else Const(True)
                    out.append(If(tuple(arms)))
                elif word == "generation":
                    out.append(Generation(body(("endgeneration",))[0]))
                elif word == "set":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad set: {rest}")
                    out.append(Set(m[1], _Expression(m[2]).whole()))
                else:
                    raise TemplateError(f"unknown tag {word}")
            else:
                out.append(Text(part))
        if until:
            raise TemplateError(f"missing {until[-1]}")
        return tuple(out), "", ""

    return body(())[0]


# --- evaluation of one node, shared by folding and closures --------------------------------------


def _text(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (str, int)):
        return str(x)
    raise TemplateError(f"can't print a {type(x).__name__}")


def _item(x: Any, key: Any) -> Any:
    if isinstance(x, Mapping):
        return x.get(key)
    if isinstance(x, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return x[key] if -len(x) <= key < len(x) else None
    if x is None:
        return None
    raise TemplateError(f"a {type(x).__name__} has no items")


def _add(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    return _text(a) + _text(b)


#: Names to functions of (value, arguments). `escape` is put in by compile_template().
FILTERS: dict[str, Callable] = {
    "escape": lambda x: _text(x),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "default": lambda x, y: y if x is None else x,
}
_BINARY: dict[str, Callable] = {"+": _add, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


# --- folding -----------------------------------------------------------------------------------


def fold(node: Any, escape: Callable[[str], str]) -> Any:
    """The same expression with constant parts computed."""
    if isinstance(node, Item):
        of, key = fold(node.of, escape), fold(node.key, escape)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Not):
        of = fold(node.of, escape)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Filter):
        of, args = fold(node.of, escape), tuple(fold(x, escape) for x in node.args)
        if isinstance(of, Const) and all(isinstance(x, Const) for x in args):
            return Const(_filter(node.name, escape)(of.value, *(x.value for x in args)))
        return Filter(node.name, of, args)
    if isinstance(node, Binary):
        left, right = fold(node.left, escape), fold(node.right, escape)
        if isinstance(left, Const) and node.op in ("and", "or"):
            return right if bool(left.value) == (node.op == "and") else left
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(_BINARY[node.op](left.value, right.value))
        return Binary(node.op, left, right)
    return node


def fold_body(body: tuple, escape: Callable[[str], str]) -> tuple:
    """The same statements: constants printed, dead arms dropped, neighbouring texts joined."""
    out: list = []

    def put(x: Any) -> None:
        if isinstance(x, Text) and (not x.text or (out and isinstance(out[-1], Text))):
            if x.text:
                out[-1] = Text(out[-1].text + x.text)
        else:
            out.append(x)

    for x in body:
        if isinstance(x, Print):
            of = fold(x.of, escape)
            put(Text(_text(of.value)) if isinstance(of, Const) else Print(of))
        elif isinstance(x, Set):
            put(Set(x.name, fold(x.of, escape)))
        elif isinstance(x, For):
            put(For(x.name, fold(x.of, escape), fold_body(x.body, escape)))
        elif isinstance(x, Generation):
            put(Generation(fold_body(x.body, escape)))
        elif isinstance(x, If):
            arms = []
            for condition, inner in x.arms:
                condition = fold(condition, escape)
                if isinstance(condition, Const) and not condition.value:
                    continue
                arms.append((condition, fold_body(inner, escape)))
                if isinstance(condition, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                for y in arms[0][1]:
                    put(y)
            elif arms:
                put(If(tuple(arms)))
        else:
            put(x)
    return tuple(out)


# --- closures ------------------------------------------------------------------------------------


def _filter(name: str, escape: Callable[[str], str]) -> Callable:
    return (lambda x: escape(_text(x))) if name == "escape" else FILTERS[name]


def _value(node: Any, escape: Callable[[str], str]) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        return lambda scope, x=node.value: x
    if isinstance(node, Name):
        return lambda scope, x=node.name: scope.get(x)
    if isinstance(node, Item):
        of, key = _value(node.of, escape), _value(node.key, escape)
        if isinstance(node.key, Const):
            return lambda scope, k=node.key.value: _item(of(scope), k)
        return lambda scope: _item(of(scope), key(scope))
    if isinstance(node, Not):
        of = _value(node.of, escape)
        return lambda scope: not of(scope)
    if isinstance(node, Filter):
        of, args, f = _value(node.of, escape), [_value(x, escape) for x in node.args], _filter(node.name, escape)
        return lambda scope: f(of(scope), *(x(scope) for x in args))
    left, right = _value(node.left, escape), _value(node.right, escape)
    if node.op == "and":
        return lambda scope: left(scope) and right(scope)
    if node.op == "or":
        return lambda scope: left(scope) or right(scope)
    f = _BINARY[node.op]
    return lambda scope: f(left(scope), right(scope))


def _statements(body: tuple, marked: bool, escape: Callable[[str], str]) -> Callable[[Scope], Iterator[Piece]]:
    steps = [_statement(x, marked, escape) for x in body]

    def run(scope: Scope) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _statement(x: Any, marked: bool, escape: Callable[[str], str]) -> Callable[[Scope], Iterable[Piece]]:
    if isinstance(x, Text):
        return lambda scope, pieces=((x.text, marked),): pieces
    if isinstance(x, Print):
        of = _value(x.of, escape)
        return lambda scope: ((_text(of(scope)), marked),)
    if isinstance(x, Set):
        of = _value(x.of, escape)

        def put(scope: Scope, name: str = x.name) -> Iterable[Piece]:
            scope[name] = of(scope)
            return ()

        return put
    if isinstance(x, Generation):
        return _statements(x.body, True, escape)
    if isinstance(x, If):
        arms = [(_value(c, escape), _statements(b, marked, escape)) for c, b in x.arms]

        def choose(scope: Scope) -> Iterable[Piece]:
            for condition, then in arms:
                if condition(scope):
                    return then(scope)
            return ()

        return choose
    of, then = _value(x.of, escape), _statements(x.body, marked, escape)

    def loop(scope: Scope, name: str = x.name) -> Iterator[Piece]:
        items = of(scope)
        if items is None:
            return
        if not isinstance(items, (list, tuple, Stream)):
            raise TemplateError("a loop takes a list")
        inner, end = dict(scope), object()
        ahead = iter(items)
        item, i = next(ahead, end), 0
        while item is not end:
            following = next(ahead, end)
            inner[name], inner["loop"] = item, {"first": i == 0, "last": following is end, "index0": i}
            yield from then(inner)
            item, i = following, i + 1

    return loop


class Template:
    """A compiled template. Called with the template's variables it gives its output as pieces of text, each with whether it is under the loss mask."""

    def __init__(self, source: str, escape: Callable[[str], str] = lambda x: x):
        self.run = _statements(fold_body(parse(source), escape), False, escape)

    def pieces(self, variables: Scope) -> Iterator[Piece]:
        """One piece at a time. A loop over a Stream has taken one item more than it has put out."""
        return (x for x in self.run(dict(variables)) if x[0])

    def __call__(self, variables: Scope) -> list[Piece]:
        return list(self.pieces(variables))


def compile_template(source: str, escape: Callable[[str], str] = lambda x: x) -> Template:
    return Template(source, escape)
