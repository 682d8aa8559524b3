"""Output formats: a bound result, row by row, as text. Large results belong in CREATE TABLE or df.write instead."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable, Iterator
from html import escape
from xml.sax.saxutils import escape as xml_escape
from xml.sax.saxutils import quoteattr

from pyspark.sql import functions as F

from veldt.functions import values as V
from veldt.plans.binder import Bound

WIDTH = 19
NUMBER = re.compile(r"^-?\d+(\.\d+)?$")


def text_rows(bound: Bound) -> Iterator[tuple[str | None, ...]]:
    """The rows as the dialect prints them, fetched partition by partition."""
    text = [V.to_text(V.Value(F.col(f"c{i}"), k)).column.alias(f"c{i}") for i, k in enumerate(bound.kinds)]
    if not text:
        return
    for row in bound.df.select(*text).toLocalIterator():
        yield tuple(row)


def _quoted(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if re.search(r'[",\n\r]', value) else value


def csv(names: tuple, rows: Iterable, headers: bool = True, excel: bool = False) -> Iterator[str]:
    """RFC 4180 lines; for spreadsheets with a byte order mark."""
    mark = "﻿" if excel else ""
    if headers:
        yield mark + ",".join(_quoted(n) for n in names) + "\n"
        mark = ""
    for row in rows:
        yield mark + ",".join(_quoted(v or "") for v in row) + "\n"
        mark = ""


def tsv(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    clean = lambda v: re.sub(r"[\t\n\r]", " ", v or "")
    if headers:
        yield "\t".join(map(clean, names)) + "\n"
    for row in rows:
        yield "\t".join(map(clean, row)) + "\n"


def _shown(value: str | None) -> str:
    return (value or "").replace("\r", "␍").replace("\n", "␊")


def table(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    """Markdown: columns at least WIDTH wide, numbers to the right."""

    def line(cells: tuple, head: bool = False) -> str:
        out = []
        for c in cells:
            c = _shown(c).replace("|", "\\|")
            out.append(f" {c:<{WIDTH}}" if head or not NUMBER.match(c) else f" {c:>{WIDTH - 1}} ")
        return "|" + "|".join(out) + "|\n"

    if headers:
        yield line(names, True)
        yield "|" + "|".join("-" * (WIDTH + 1) for _ in names) + "|\n"
    for row in rows:
        yield line(row)


def box(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    """A frame around cells of fixed width; longer values end in an ellipsis."""

    def cell(c: str | None, head: bool = False) -> str:
        c = _shown(c)
        c = c if len(c) <= WIDTH else c[: WIDTH - 1] + "…"
        return f"{c:>{WIDTH}}" if NUMBER.match(c) and not head else f"{c:<{WIDTH}}"

    rule = lambda a, b, c: a + b.join("─" * (WIDTH + 2) for _ in names) + c + "\n"
    yield rule("┌", "┬", "┐")
    if headers:
        yield "│ " + " │ ".join(cell(n, True) for n in names) + " │\n"
        yield rule("├", "┼", "┤")
    for row in rows:
        yield "│ " + " │ ".join(map(cell, row)) + " │\n"
    yield rule("└", "┴", "┘")


def html(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    yield "<table>\n"
    if headers:
        yield "<thead><tr>" + "".join(f"<th>{escape(n)}</th>" for n in names) + "</tr></thead>\n"
    yield "<tbody>\n"
    for row in rows:
        yield "<tr>" + "".join(f'<td style="text-align:right">{c}</td>' if c and NUMBER.match(c) else f"<td>{escape(c or '')}</td>" for c in row) + "</tr>\n"
    yield "</tbody>\n</table>\n"


def _json(value: str | None) -> str:
    if value is None or value == "":
        return "null"
    return value if NUMBER.match(value) and not re.match(r"-?0\d", value) else json.dumps(value, ensure_ascii=False)


def json_objects(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    start = "["
    for row in rows:
        yield start + "{" + ",".join(f"{json.dumps(n, ensure_ascii=False)}:{_json(v)}" for n, v in zip(names, row, strict=True)) + "}"
        start = ",\n"
    yield ("[" if start == "[" else "") + "]\n"


def json_arrays(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    """An array of arrays, the header first; a sole column called _ gives a flat array."""
    flat = names == ("_",)
    start = "["
    if headers and not flat:
        yield start + "[" + ",".join(json.dumps(n, ensure_ascii=False) for n in names) + "]"
        start = ",\n"
    for row in rows:
        yield start + (_json(row[0]) if flat else "[" + ",".join(map(_json, row)) + "]")
        start = ",\n"
    yield ("[" if start == "[" else "") + "]\n"


def xml(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    """Rows as elements with attributes; a column called _ is the element's text."""
    yield "<results>\n"
    for row in rows:
        cells = list(zip(names, row, strict=True))
        attributes = "".join(f" {re.sub(r'[^\w.-]', '_', n)}={quoteattr(v)}" for n, v in cells if n != "_" and v is not None)
        inner = "".join(xml_escape(v or "") for n, v in cells if n == "_")
        yield f"  <row{attributes}>{inner}</row>\n" if inner else f"  <row{attributes} />\n"
    yield "</results>\n"


def _sql(value: str | None) -> str:
    if value is None or value == "":
        return "NULL"
    return value if NUMBER.match(value) else "'" + value.replace("'", "''") + "'"


def _identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _values(rows: Iterable) -> Iterator[str]:
    start = ""
    for row in rows:
        yield start + "(" + ",".join(map(_sql, row)) + ")"
        start = ",\n"


def sql_values(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    yield "VALUES\n"
    yield from _values(rows)
    yield ";\n"


def sql_insert(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    listed = " (" + ",".join(map(_identifier, names)) + ")" if headers else ""
    yield f'INSERT INTO "table"{listed} VALUES\n'
    yield from _values(rows)
    yield ";\n"


def sql_create(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    yield 'CREATE TABLE "table" (' + ",".join(f"{_identifier(n)} TEXT" for n in names) + ");\n"
    yield from sql_insert(names, rows, headers)


def record(names: tuple, rows: Iterable, headers: bool = True) -> Iterator[str]:
    """ASCII separators: header between 01 and 02, records end in 1E, units are parted by 1F."""
    if headers:
        yield "\x01" + "\x1f".join(names) + "\x02"
    for row in rows:
        yield "\x1f".join(v or "" for v in row) + "\x1e"


FORMATS = {
    "csv": csv,
    "csv:excel": lambda n, r, h=True: csv(n, r, h, True),
    "tsv": tsv,
    "table": table,
    "box": box,
    "html": html,
    "json": json_objects,
    "json:object": json_objects,
    "json:array": json_arrays,
    "xml": xml,
    "sql": sql_insert,
    "sql:insert": sql_insert,
    "sql:values": sql_values,
    "sql:create": sql_create,
    "record": record,
}


def render(bound: Bound, form: str = "csv", headers: bool = True) -> Iterator[str]:
    """The pieces of the text of a result."""
    if form not in FORMATS:
        raise ValueError(f"no format {form}; there are {', '.join(FORMATS)}")
    return FORMATS[form](bound.names, text_rows(bound), headers)


def write_stats(timings: list[tuple[str, float]], path: str) -> None:
    """Phases and their seconds as CSV."""
    with open(path, "w") as f:
        f.write("phase,microseconds,at\n")
        f.writelines(f"{name},{seconds * 1e6:.0f},{time.time():.0f}\n" for name, seconds in timings)
