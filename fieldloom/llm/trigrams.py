"""Boolean trigram queries from regular expressions.

compile_query() parses a regular expression and works out which trigrams every match must contain:
a tree of And, Or and single trigrams, or ANY where nothing can be said. The analysis keeps, for each
part, the strings that it can be exactly (while they are few), or else the possible prefixes and
suffixes, and a query for what is certain inside. ASCII letters are taken in lower case, since the
index is of lower-cased text.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from itertools import product

try:  # the parser of the standard library, under its present and its former name
    from re import _constants as sre, _parser as sre_parser
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse as sre_parser

#: Bounds of the sets that the analysis keeps; beyond them it says less, never something wrong.
MOST_STRINGS, MOST_CLASS = 32, 12


@dataclass(frozen=True)
class Query:
    """kind: 'any', 'tri', 'and' or 'or'."""

    kind: str
    tri: str = ""
    parts: frozenset = field(default_factory=frozenset)

    def trigrams(self) -> set[str]:
        return {self.tri} if self.kind == "tri" else set().union(*(x.trigrams() for x in self.parts))

    def __str__(self) -> str:
        if self.kind in ("any", "tri"):
            return repr(self.tri) if self.tri else "any"
        return "(" + f" {self.kind} ".join(sorted(map(str, self.parts))) + ")"


ANY = Query("any")


def both(*queries: Query) -> Query:
    parts = {y for x in queries for y in (x.parts if x.kind == "and" else [x]) if y.kind != "any"}
    return ANY if not parts else next(iter(parts)) if len(parts) == 1 else Query("and", parts=frozenset(parts))


def either(*queries: Query) -> Query:
    if not queries or any(x.kind == "any" for x in queries):
        return ANY
    parts = {y for x in queries for y in (x.parts if x.kind == "or" else [x])}
    # what one arm asks and more is no arm of its own
    needs = {x: {x} if x.kind != "and" else set(x.parts) for x in parts}
    parts = {x for x in parts if not any(needs[y] < needs[x] for y in parts)}
    return next(iter(parts)) if len(parts) == 1 else Query("or", parts=frozenset(parts))


def of_strings(strings: set[str]) -> Query:
    """Some string of the set occurs."""
    arms = []
    for s in strings:
        if len(s) < 3:
            return ANY
        arms.append(both(*(Query("tri", s[i : i + 3]) for i in range(len(s) - 2))))
    return either(*arms)


@dataclass
class Part:
    """exact: all strings that the part can be, or None; else what a match starts and ends with, and what is certain in it."""

    exact: set[str] | None
    prefix: set[str]
    suffix: set[str]
    query: Query = ANY


def _set(strings: set[str]) -> Part:
    return Part(strings, strings, strings)


UNKNOWN = Part(None, {""}, {""})


def _loose(x: Part) -> Part:
    """Without its exact set: long strings are cut to prefixes and suffixes, the trigrams go into the query."""
    if x.exact is None:
        return x
    return Part(None, {s[:3] for s in x.exact}, {s[-3:] for s in x.exact}, both(x.query, of_strings(x.exact)))


def _joined(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _set({x + y for x, y in product(a.exact, b.exact)})
    query = both(a.query, b.query)
    if len(a.suffix) * len(b.prefix) <= 4 * MOST_STRINGS:
        query = both(query, of_strings({x + y for x, y in product(a.suffix, b.prefix)}))
    if a.exact is not None:
        query = both(query, of_strings(a.exact))
    if b.exact is not None:
        query = both(query, of_strings(b.exact))
    prefix = {x + y for x, y in product(a.exact, b.prefix)} if a.exact is not None else a.prefix
    suffix = {x + y for x, y in product(a.suffix, b.exact)} if b.exact is not None else b.suffix
    cut = lambda strings, at: {s[at] for s in strings} if len(strings) <= MOST_STRINGS else {""}
    return Part(None, cut(prefix, slice(0, 3)), cut(suffix, slice(-3, None)), query)


def _any_of(parts: list[Part]) -> Part:
    if all(x.exact is not None for x in parts) and len(set().union(*(x.exact for x in parts))) <= MOST_STRINGS:
        return _set(set().union(*(x.exact for x in parts)))
    parts = [_loose(x) for x in parts]
    prefix, suffix = set().union(*(x.prefix for x in parts)), set().union(*(x.suffix for x in parts))
    return Part(None, prefix if len(prefix) <= MOST_STRINGS else {""}, suffix if len(suffix) <= MOST_STRINGS else {""}, either(*(x.query for x in parts)))


def _class(items: list) -> Part:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value))
        elif op is sre.RANGE:
            if value[1] - value[0] > MOST_CLASS:
                return UNKNOWN
            found |= {chr(x) for x in range(value[0], value[1] + 1)}
        else:
            return UNKNOWN
    return _set({_lower(x) for x in found}) if len(found) <= MOST_CLASS else UNKNOWN


def _lower(x: str) -> str:
    return x.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def _analysed(tree) -> Part:  # noqa: ANN001
    out = _set({""})
    for op, value in tree:
        if op is sre.LITERAL:
            part = _set({_lower(chr(value))})
        elif op is sre.IN:
            part = _class(value)
        elif op is sre.BRANCH:
            part = _any_of([_analysed(x) for x in value[1]])
        elif op is sre.SUBPATTERN:
            part = _analysed(value[-1])
        elif op is sre.ATOMIC_GROUP:
            part = _analysed(value)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            one = _analysed(inner)
            if low == 0 and high == 1:
                part = _any_of([_set({""}), one])
            elif low == 0:
                part = UNKNOWN
            else:
                part = one
                for _ in range(min(low, 8) - 1):
                    part = _joined(part, one)
                if high != low or low > 8:
                    loose = _loose(part)
                    part = Part(None, loose.prefix, _loose(one).suffix if high != low else {""}, loose.query)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue  # looks around take no text of their own
        else:
            part = UNKNOWN
        out = _joined(out, part)
    return out


def compile_query(pattern: str) -> Query:
    """The trigrams that any match of `pattern` must have (with ASCII letters in lower case)."""
    return _loose(_analysed(sre_parser.parse(pattern))).query
