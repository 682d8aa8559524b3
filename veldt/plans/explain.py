"""EXPLAIN as a table: one row for each operator of the physical plan."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

LONGEST = 2**63 - 1


def _estimates(node) -> tuple[int | None, int | None]:
    """Rows and bytes that Catalyst expects of an operator; rows follow from bytes and the width of a row where no
    statistics tell them."""
    link = node.logicalLink()
    if not link.isDefined():
        return None, None
    stats = link.get().stats()
    size = int(str(stats.sizeInBytes()))
    if stats.rowCount().isDefined():
        return int(str(stats.rowCount().get())), size
    output = link.get().output()
    width = 8 + sum(output.apply(i).dataType().defaultSize() for i in range(output.size()))
    return size // width, size


def _walk(node) -> Iterator:
    """The operators of a plan, children after their parent; wrappers of adaptive execution are looked through."""
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.executedPlan()
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _walk(children.apply(i))


def plan_rows(df: DataFrame) -> list[tuple]:
    """(ID, Operation, Table, Predicate, Rows, Cost, Detail), leaves last. Cost is the bytes that pass the operator: those
    it gives and those its inputs give."""
    rows = []
    for node in _walk(df._jdf.queryExecution().executedPlan()):
        name, detail = node.nodeName(), node.simpleString(100)
        expected, size = _estimates(node)
        children = node.children()
        given = [_estimates(children.apply(i))[1] for i in range(children.size())]
        cost = None if size is None else min(size + sum(x or 0 for x in given), LONGEST)
        table = re.search(r"Location: \S+\[([^\]]*)\]", detail)
        predicate = re.search(r"PushedFilters: \[([^\]]*)\]", detail) if name != "Filter" else re.match(r"Filter\s*(.*)", detail)
        rows.append((len(rows), name.strip(), table[1] if table else None, predicate[1].strip() or None if predicate else None, None if expected is None else min(expected, LONGEST), cost, detail.strip()))
    return rows


def explain(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame(plan_rows(df), "ID int, Operation string, `Table` string, Predicate string, Rows long, Cost long, Detail string")
