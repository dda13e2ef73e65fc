"""Boolean trigram queries of regular expressions.

Text and pattern are folded alike: bytes of UTF-8, A-Z as a-z, every byte of a
non-ASCII character as one sign. A query is ANY (no trigram is mandatory), a trigram
code, or ("and" | "or", queries). Every text that the pattern matches satisfies the
pattern's query, so texts that do not are never searched.

For each part of a pattern the derivation keeps the strings that it matches exactly,
while they are few, or else the strings that its matches begin and end with, and the
query found so far. Concatenation joins ends with beginnings; alternatives are or-ed.
"""

import re
from re import _constants as sre
from re import _parser as parser
from typing import NamedTuple

import numpy as np

FOLD = np.arange(256, dtype=np.uint32)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[128:] = 127
CODES = 1 << 21
ANY = "any"
MANY = 48  # strings kept for a part
WIDE_CLASS = 8  # characters of a class that is still spelled out


def fold(text):
    """The folded bytes of a text."""
    return bytes(FOLD[np.frombuffer(text.encode(), np.uint8)].astype(np.uint8))


def code(trigram):
    """A folded trigram as a number below CODES."""
    a, b, c = trigram
    return a << 14 | b << 7 | c


def both(*queries):
    """All of the queries hold."""
    return _combined("and", queries)


def either(*queries):
    """One of the queries holds."""
    return _combined("or", queries)


def _combined(kind, queries):
    flat = set()
    for q in queries:
        flat.update(q[1] if isinstance(q, tuple) and q[0] == kind else [q])
    if kind == "or" and ANY in flat:
        return ANY
    flat.discard(ANY)
    if not flat:
        return ANY
    return flat.pop() if len(flat) == 1 else (kind, frozenset(flat))


def _spelled(strings):
    """One of these strings occurs."""
    return either(
        *[both(*[code(s[i : i + 3]) for i in range(len(s) - 2)]) if len(s) > 2 else ANY for s in strings]
    )


class Part(NamedTuple):
    exact: frozenset | None
    begins: frozenset
    ends: frozenset
    query: object


EMPTY = frozenset([b""])
NOTHING = Part(EMPTY, EMPTY, EMPTY, ANY)
ANYTHING = Part(None, EMPTY, EMPTY, ANY)


def _of(strings):
    return _bounded(Part(frozenset(strings), frozenset(strings), frozenset(strings), ANY))


def _bounded(part):
    """The part with few and short strings; what is cut off goes into the query first."""
    exact, begins, ends, query = part
    if exact is not None:
        if len(exact) <= MANY and sum(map(len, exact)) <= 64 * MANY:
            return Part(exact, exact, exact, query)
        query, begins, ends = both(query, _spelled(exact)), exact, exact
    if len(begins) > MANY or max(map(len, begins)) > 16:
        query = both(query, _spelled(begins))
        begins = frozenset(s[:2] for s in begins)
        begins = begins if len(begins) <= MANY else EMPTY
    if len(ends) > MANY or max(map(len, ends)) > 16:
        query = both(query, _spelled(ends))
        ends = frozenset(s[-2:] for s in ends)
        ends = ends if len(ends) <= MANY else EMPTY
    return Part(None, begins, ends, query)


def _cross(a, b):
    return frozenset(x + y for x in a for y in b)


def _then(a, b):
    query = both(a.query, b.query)
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MANY * MANY:
        crossed = _cross(a.exact, b.exact)
        return _bounded(Part(crossed, crossed, crossed, query))
    if len(a.ends) * len(b.begins) <= MANY * MANY:
        query = both(query, _spelled(_cross(a.ends, b.begins)))
    begins = _cross(a.exact, b.begins) if a.exact is not None else a.begins
    ends = _cross(a.ends, b.exact) if b.exact is not None else b.ends
    return _bounded(Part(None, begins, ends, query))


def _whole(part):
    """The query of a part that stands alone."""
    return both(part.query, _spelled(part.begins), _spelled(part.ends))


def _or(a, b):
    if a.exact is not None and b.exact is not None and a.query is b.query is ANY:
        return _bounded(Part(a.exact | b.exact, EMPTY, EMPTY, ANY))
    return _bounded(Part(None, a.begins | b.begins, a.ends | b.ends, either(_whole(a), _whole(b))))


def _class(items):
    """The characters of a class, or None if they are many."""
    found = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            found.add(value)
        elif kind is sre.RANGE and value[1] - value[0] < 2 * WIDE_CLASS:
            found.update(range(value[0], value[1] + 1))
        else:
            return None
    found = {fold(chr(c)) for c in found}
    return found if len(found) <= WIDE_CLASS else None


def _node(kind, value):
    if kind is sre.LITERAL:
        return _of([fold(chr(value))])
    if kind is sre.IN:
        found = _class(value)
        return ANYTHING if found is None else _of(found)
    if kind is sre.SUBPATTERN:
        return _sequence(value[-1])
    if kind is sre.ATOMIC_GROUP:
        return _sequence(value)
    if kind is sre.BRANCH:
        out = None
        for branch in value[1]:
            part = _sequence(branch)
            out = part if out is None else _or(out, part)
        return out
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        part = _sequence(inner)
        if most == 1:
            return part if least else _or(NOTHING, part)
        if least == 0:
            return ANYTHING
        out = part
        for _ in range(min(least, 16) - 1):
            out = _then(out, part)
        if least == most and least <= 16:
            return out
        return _bounded(Part(None, out.begins, out.ends, _whole(out)))
    if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return NOTHING
    return ANYTHING


def _sequence(nodes):
    out = NOTHING
    for kind, value in nodes:
        out = _then(out, _node(kind, value))
    return out


def trigram_query(pattern, flags=0):
    """The query of a pattern; ANY if it has no mandatory trigram.

    Letters match in either case only with the ASCII flag: otherwise a few non-ASCII
    letters count as ASCII ones, which folded text does not show.
    """
    tree = parser.parse(pattern, flags)
    if tree.state.flags & re.IGNORECASE and not tree.state.flags & re.ASCII:
        raise ValueError("patterns that ignore case need the ASCII flag")
    return _whole(_sequence(tree))


def codes_of(query):
    """Every trigram code that a query names."""
    if query == ANY:
        return set()
    if isinstance(query, tuple):
        return set().union(*map(codes_of, query[1]))
    return {query}


def evaluate(query, postings, everything):
    """The sorted members that satisfy a query, from sorted postings by code."""
    if query == ANY:
        return everything
    if not isinstance(query, tuple):
        return postings.get(query, everything[:0])
    parts = sorted((evaluate(q, postings, everything) for q in query[1]), key=len)
    out = parts[0] if parts else everything
    for part in parts[1:]:
        if query[0] == "or":
            out = np.union1d(out, part)
        elif len(out):
            out = np.intersect1d(out, part, assume_unique=True)
    return out
