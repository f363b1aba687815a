"""CSS selectors: tag, .class, #id, [a], [a="v"] and its forms *=, ^=, $=, ~=, comma, the combinators
descendant, >, + and ~, and :first-child, :last-child, :only-child, :nth-child(an+b), :not(...).

A selector becomes plain data, which serves twice: as a native predicate over
elements and as the `keep` list that tells the page reader which elements
to emit.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from bookweir.functions.arrays import let, quote

_SIMPLE = re.compile(
    r"""(?P<tag>^[A-Za-z][\w-]*|^\*)
      | \.(?P<cls>[\w-]+)
      | \#(?P<id>[\w-]+)
      | :(?P<pseudo>[a-z-]+)(?:\((?P<arg>(?:"[^"]*"|'[^']*'|[^)"'])*)\))?
      | \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>[^"'\]\s]*))\s*)?\]""",
    re.VERBOSE,
)
_OPS = {None: "has", "=": "eq", "*=": "contains", "^=": "starts", "$=": "ends", "~=": "token"}
# A word, a comma or a combinator; brackets, parentheses and quotes hold theirs together.
_PARTS = re.compile(
    r"""(?:\[(?:"[^"]*"|'[^']*'|[^\]"'])*\]|\((?:"[^"]*"|'[^']*'|[^)"'])*\)|[^\s,>+~\[(])+|[,>+~]"""
)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<step>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<by>\d+))?|(?P<only>[+-]?\d+))\s*")


class AttrTest(NamedTuple):
    attr: str
    op: str  # has, eq, contains, starts, ends, token
    value: str = ""


class Place(NamedTuple):
    """A test on an element's number among its siblings: step * i + offset for an i of 0 or more, or the last."""

    step: int = 0
    offset: int = 1
    last: bool = False


class Simple(NamedTuple):
    """One element test: a tag (None for any), attribute tests, places among siblings, and what it must not be.

    `link` says how the element is tied to the one before it in its chain.
    """

    tag: str | None
    tests: tuple[AttrTest, ...] = ()
    places: tuple[Place, ...] = ()
    but: tuple[Simple, ...] = ()
    link: str = " "


def parse(css: str) -> list[list[Simple]]:
    """Alternatives, each a chain of element tests from the outermost inwards."""
    chains: list[list[Simple]] = [[]]
    end, link = 0, " "
    for part in _PARTS.finditer(css):
        if css[end : part.start()].strip():
            break
        end = part.end()
        if part[0] in (">", "+", "~"):
            if link != " " or not chains[-1]:
                break
            link = part[0]
        elif part[0] == ",":
            if link != " ":
                break
            chains.append([])
        else:
            chains[-1].append(_simple(part[0], link))
            link = " "
    else:
        if not css[end:].strip() and all(chains) and link == " ":
            return chains
    raise ValueError(f"unsupported selector: {css!r}")


def _simple(word: str, link: str = " ") -> Simple:
    tag, tests, places, but, end = None, [], [], [], 0
    for m in _SIMPLE.finditer(word):
        if m.start() != end:
            break
        end = m.end()
        if m["tag"]:
            tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["cls"]:
            tests.append(AttrTest("class", "token", m["cls"]))
        elif m["id"]:
            tests.append(AttrTest("id", "eq", m["id"]))
        elif m["pseudo"] == "not" and m["arg"] is not None:
            inner = parse(m["arg"])
            if any(len(chain) > 1 for chain in inner):
                raise ValueError(f"unsupported selector: {word!r}")
            but += [chain[0] for chain in inner]
        elif m["pseudo"]:
            places += _places(m["pseudo"], m["arg"], word)
        else:
            tests.append(AttrTest(m["attr"].lower(), _OPS[m["op"]], m["double"] or m["single"] or m["bare"] or ""))
    if end != len(word):
        raise ValueError(f"unsupported selector: {word!r}")
    return Simple(tag, tuple(tests), tuple(places), tuple(but), link)


def _places(name: str, arg: str | None, word: str) -> list[Place]:
    plain = {"first-child": [Place()], "last-child": [Place(last=True)], "only-child": [Place(), Place(last=True)]}
    if arg is None and name in plain:
        return plain[name]
    m = _NTH.fullmatch(arg or "") if name == "nth-child" else None
    if m is None:
        raise ValueError(f"unsupported selector: {word!r}")
    if m["word"]:
        return [Place(2, 1 if m["word"] == "odd" else 0)]
    if m["only"]:
        return [Place(0, int(m["only"]))]
    step = int(m["step"] + "1") if m["step"] in ("", "+", "-") else int(m["step"])
    return [Place(step, int((m["sign"] or "+") + (m["by"] or "0")))]


def plain(css: str) -> bool:
    """Whether a selector needs nothing of an element's siblings or parent."""
    return not any(s.places or s.but or s.link != " " for chain in parse(css) for s in chain)


def predicate(simples: list[Simple], node: str | None = None) -> str:
    """SQL text: whether an element passes any of the tests; never null.

    `node` is a struct, by default the row itself.
    """
    prefix = f"{node}." if node else ""
    return "(" + " OR ".join(_all_of(simple, prefix) for simple in simples) + ")" if simples else "false"


def _all_of(simple: Simple, prefix: str) -> str:
    checks = [] if simple.tag is None else [f"{prefix}tag = {quote(simple.tag)}"]
    for test in simple.tests:
        found, value = f"try_element_at({prefix}attrs, {quote(test.attr)})", quote(test.value)
        if test.op == "has":
            checks.append(f"{found} IS NOT NULL")
        elif test.op == "eq":
            checks.append(f"coalesce({found} = {value}, false)")
        elif test.op == "token":
            checks.append(rf"coalesce(array_contains(split({found}, r'[ \t\n\f\r]+'), {value}), false)")
        else:
            function = {"contains": "contains", "starts": "startswith", "ends": "endswith"}[test.op]
            checks.append(f"coalesce({function}({found}, {value}), false)" if test.value else "false")
    for place in simple.places:
        if place.last:
            checks.append(f"{prefix}last")
        elif place.step:
            past = f"({prefix}nth - ({place.offset}))"
            checks.append(f"({past} % {abs(place.step)} = 0 AND {past} * {place.step} >= 0)")
        else:
            checks.append(f"{prefix}nth = {place.offset}")
    checks += [f"NOT {_all_of(one, prefix)}" for one in simple.but]
    return "(" + " AND ".join(checks or ["true"]) + ")"


def _tied(link: str, node: str) -> str:
    """SQL text: whether an element is tied as `link` says to one of the array `outer`."""
    if link == " ":
        return f"arrays_overlap({node}.up, transform(outer, o -> o.pre))"
    if link in (">", "+"):
        named = f"{node}.parent" if link == ">" else f"{node}.prev"
        return f"coalesce(array_contains(transform(outer, o -> o.pre), {named}), false)"
    return f"exists(outer, o -> o.pre < {node}.pre AND o.parent <=> {node}.parent)"


def matching(css: str, nodes: str = "nodes") -> str:
    """SQL text: the elements of an array that match, in document order.

    From the outermost test inwards: what one test found is kept with its numbers, and an
    element is tied to it by the numbers of its enclosing elements, its parent or its siblings.
    """
    kept = "named_struct('pre', m.pre, 'parent', m.parent)"
    chains = []
    for chain in parse(css):
        found = f"transform(filter({nodes}, n -> {predicate([chain[0]], 'n')}), m -> {kept})"
        for simple in chain[1:]:
            inside = f"{predicate([simple], 'n')} AND {_tied(simple.link, 'n')}"
            found = let("outer", found, f"transform(filter({nodes}, n -> {inside}), m -> {kept})")
        chains.append(f"transform({found}, m -> m.pre)")
    if len(chains) == 1 and len(parse(css)[0]) == 1:
        return f"filter({nodes}, n -> {predicate(parse(css)[0], 'n')})"
    return let("found", f"array_distinct(flatten(array({', '.join(chains)})))", f"filter({nodes}, n -> array_contains(found, n.pre))")


def element_tests(*css: str) -> list[Simple]:
    """Every element test that occurs in the selectors: the `keep` list for them, by tag and attributes alone."""
    return sorted({Simple(s.tag, s.tests) for text in css for chain in parse(text) for s in chain}, key=repr)
