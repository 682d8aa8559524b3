"""The parsed form of expressions and queries."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace


@dataclass(frozen=True)
class Literal:
    value: object  # str, int, float or None


@dataclass(frozen=True)
class Name:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    filter: object = None  # of aggregates


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    arg: object


@dataclass(frozen=True)
class Is:
    arg: object
    value: object
    negated: bool = False


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object
    open_end: bool = False


@dataclass(frozen=True)
class In:
    arg: object
    values: tuple


@dataclass(frozen=True)
class Scalar:
    query: Query


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None
    text: str  # the expression as it stands, white space collapsed


@dataclass(frozen=True)
class Order:
    expr: object
    descending: bool = False


@dataclass(frozen=True)
class Source:
    name: str | None  # a file, table or built-in; None with query or values
    args: tuple = ()
    query: Query | None = None
    values: tuple | None = None
    alias: str | None = None
    columns: tuple | None = None
    how: str = "first"  # first, cross, inner, left
    on: tuple = ()
    using: object = None


@dataclass(frozen=True)
class Query:
    sources: tuple = ()
    items: tuple | None = None
    where: tuple = ()
    group: tuple = ()
    order: tuple = ()
    offset: int = 0
    limit: int | None = None
    ctes: tuple = ()
    values: tuple | None = None
    explain: bool = False


@dataclass(frozen=True)
class Create:
    kind: str  # table, temp, view, index, unique
    name: str | None
    columns: tuple | None = None
    query: Query | None = None
    text: str = ""
    on: str | None = None


@dataclass(frozen=True)
class Insert:
    name: str
    query: Query


@dataclass(frozen=True)
class Drop:
    name: str


@dataclass(frozen=True)
class Lock:
    pass



def walk(node):
    """The node and all expressions in it, but not those of sub-queries."""
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node):
        yield node
        if not isinstance(node, Scalar | Query):
            for f in fields(node):
                yield from walk(getattr(node, f.name))


def rewrite(node, change):
    """The node with change applied to every expression from the leaves up; change returns a node or None to keep it."""
    if isinstance(node, tuple):
        return tuple(rewrite(x, change) for x in node)
    if not is_dataclass(node) or isinstance(node, Query):
        return node
    if not isinstance(node, Scalar):
        new = {f.name: rewrite(getattr(node, f.name), change) for f in fields(node)}
        node = replace(node, **new)
    got = change(node)
    return node if got is None else got


def conjuncts(node) -> tuple:
    """A predicate as the list of predicates that must all hold."""
    if isinstance(node, Binary) and node.op == "AND":
        return conjuncts(node.left) + conjuncts(node.right)
    return (node,)


def as_json(node):
    """The syntax tree as plain lists and dicts."""
    if isinstance(node, tuple):
        return [as_json(x) for x in node]
    if is_dataclass(node):
        return {"node": type(node).__name__} | {f.name: as_json(getattr(node, f.name)) for f in fields(node)}
    return node
