"""Values with a kind, and the operators between them.

Typed columns have one kind and get one expression. Text columns (of text files) have whatever kind their content has:
for them an operator becomes a chain of cases over the kinds that both sides can have, all in Column expressions.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.functions import dates as D

INT_TEXT = r"^ *-?[0-9]+$"
NUMBER_TEXT = r"^ *-?([0-9]+\.?[0-9]*|\.[0-9]+)$"
MISSING = object()


@dataclass(frozen=True)
class Value:
    """A column and its kind: int, double, string, text, date, datetime, time (in seconds), bool, null or other."""

    column: Column
    kind: str
    const: object = MISSING
    aggregate: bool = False

    @property
    def is_const(self) -> bool:
        return self.const is not MISSING


def kind_of(data_type: T.DataType, text: bool = False) -> str:
    if isinstance(data_type, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(data_type, T.FloatType | T.DoubleType | T.DecimalType):
        return "double"
    if isinstance(data_type, T.StringType):
        return "text" if text else "string"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.TimestampType | T.TimestampNTZType):
        return "datetime"
    return "bool" if isinstance(data_type, T.BooleanType) else "null" if isinstance(data_type, T.NullType) else "other"


def literal(value: object) -> Value:
    if value is None or value == "":
        return Value(F.lit(None).cast("string"), "null", None)
    kind = "int" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
    return Value(F.lit(value).cast("long") if kind == "int" else F.lit(value), kind, value)


def kinds(v: Value) -> tuple[str, ...]:
    """The kinds a value may have, the most special first."""
    if v.kind == "text":
        return ("datetime", "date", "time", "int", "double", "string")
    if v.kind == "string" and v.is_const:
        if D.parse_datetime(v.const):
            return ("datetime", "date", "string")
        if D.parse_date(v.const) or D.is_far(v.const):
            return ("date", "string")
        if D.parse_time(v.const) is not None:
            return ("time", "string")
        return ("int", "string") if re.match(INT_TEXT, v.const) else ("double", "string") if re.match(NUMBER_TEXT, v.const) else ("string",)
    if v.kind == "datetime":
        return ("datetime", "date")
    return ("int",) if v.kind == "bool" else (v.kind,)


def is_kind(v: Value, kind: str) -> Column | None:
    """Whether the value has the kind; None where that is sure."""
    if v.kind != "text":
        return None
    x = v.column
    if kind == "datetime":
        return D.datetime_of_text(x).isNotNull()
    if kind == "date":
        return D.date_of_text(x).isNotNull()
    patterns = {"time": D.TIME, "int": INT_TEXT, "double": NUMBER_TEXT}
    return x.rlike(patterns[kind]) if kind in patterns else None


def as_kind(v: Value, kind: str) -> Column:
    """The value's column as that kind has it."""
    x = v.column
    if kind == "string":
        return to_text(v).column
    if v.kind in ("text", "string"):
        if v.is_const:
            if kind == "datetime":
                return F.lit(D.parse_datetime(v.const)).cast("timestamp_ntz")
            if kind == "date":
                return date_column(v)
            if kind == "time":
                return F.lit(D.parse_time(v.const)).cast("long")
            return F.lit(int(v.const) if kind == "int" else float(v.const)).cast("long" if kind == "int" else "double")
        if kind == "datetime":
            return D.datetime_of_text(x)
        if kind == "date":
            return D.date_of_text(x)
        if kind == "time":
            return D.seconds_of_text(x)
        return F.trim(x).try_cast("long" if kind == "int" else "double")
    if kind == "date" and v.kind == "datetime":
        return x.cast("date")
    if kind == "datetime":
        return x.cast("timestamp_ntz")
    if kind == "int" and v.kind == "bool":
        return x.cast("long")
    if kind == "double" and v.kind == "int":
        return x.cast("double")
    return x


def to_text(v: Value) -> Value:
    """The value as the dialect prints it."""
    if v.kind in ("text", "string", "null"):
        return Value(v.column, "string" if v.kind != "text" else "text", v.const)
    if v.kind == "date":
        return Value(D.format_date(v.column), "string")
    if v.kind == "datetime":
        return Value(D.format_datetime(v.column), "string")
    if v.kind == "time":
        return Value(D.format_seconds(v.column), "string")
    if v.kind == "bool":
        return Value(v.column.cast("int").cast("string"), "string")
    if v.kind == "double":
        whole = (v.column == F.floor(v.column)) & (F.abs(v.column) < 1e15)
        return Value(F.when(whole, v.column.cast("decimal(18,0)").cast("string")).otherwise(v.column.cast("string")), "string")
    return Value(v.column.cast("string"), "string")


def date_column(v: Value) -> Column:
    """Any value as a date; null where it is none."""
    if v.kind == "text" or (v.kind == "string" and not v.is_const):
        return D.date_of_text(v.column)
    if v.kind == "string":
        day = D.parse_date(str(v.const))
        return D.date_of_text(F.lit(v.const)) if day is None else F.lit(day.isoformat()).cast("date")
    return v.column.cast("date") if v.kind in ("date", "datetime") else F.lit(None).cast("date")


def datetime_column(v: Value) -> Column:
    if v.kind in ("text", "string"):
        return D.datetime_of_text(v.column)
    return v.column.cast("timestamp_ntz") if v.kind in ("datetime", "date") else F.lit(None).cast("timestamp_ntz")


def int_column(v: Value) -> Column:
    """Any value as a whole number, truncated; null where it is none."""
    if v.kind == "int":
        return v.column
    if v.kind == "double":
        return v.column.cast("long")
    if v.kind == "bool":
        return v.column.cast("long")
    if v.kind in ("text", "string"):
        clean = F.trim(v.column)
        return F.when(v.column.rlike(INT_TEXT), clean.try_cast("long")).when(v.column.rlike(NUMBER_TEXT), clean.try_cast("double").try_cast("long"))
    return F.lit(None).cast("long")


def _zero_is_null(c: Column) -> Column:
    return F.when(c != 0, c)


def _seconds(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))


def _between(a: Column, b: Column) -> Column:
    """Whole seconds from b to a."""
    return F.timestamp_diff("SECOND", b, a).cast("long")


Rule = tuple[str, Callable[[Column, Column], Column]]
_INT_DIV = lambda a, b: F.try_divide(a - a % _zero_is_null(b), b).cast("long")
#: Operator -> {(left kind, right kind): (kind of the result, expression)}.
RULES: dict[str, dict[tuple[str, str], Rule]] = {
    "+": {
        ("int", "int"): ("int", lambda a, b: a + b),
        ("double", "double"): ("double", lambda a, b: a + b),
        ("datetime", "int"): ("datetime", lambda a, b: a + _seconds(b)),
        ("int", "datetime"): ("datetime", lambda a, b: b + _seconds(a)),
        ("date", "int"): ("date", lambda a, b: F.date_add(a, b.cast("int"))),
        ("int", "date"): ("date", lambda a, b: F.date_add(b, a.cast("int"))),
        ("time", "int"): ("time", lambda a, b: a + b),
        ("int", "time"): ("time", lambda a, b: a + b),
        ("time", "time"): ("time", lambda a, b: a + b),
    },
    "-": {
        ("int", "int"): ("int", lambda a, b: a - b),
        ("double", "double"): ("double", lambda a, b: a - b),
        ("datetime", "datetime"): ("int", _between),
        ("date", "date"): ("int", lambda a, b: F.datediff(a, b).cast("long")),
        ("time", "time"): ("int", lambda a, b: a - b),
        ("datetime", "int"): ("datetime", lambda a, b: a - _seconds(b)),
        ("date", "int"): ("date", lambda a, b: F.date_sub(a, b.cast("int"))),
        ("time", "int"): ("time", lambda a, b: a - b),
    },
    "*": {
        ("int", "int"): ("int", lambda a, b: a * b),
        ("double", "double"): ("double", lambda a, b: a * b),
        ("time", "int"): ("time", lambda a, b: a * b),
        ("int", "time"): ("time", lambda a, b: a * b),
    },
    "/": {
        ("int", "int"): ("int", _INT_DIV),
        ("double", "double"): ("double", F.try_divide),
        ("time", "int"): ("time", _INT_DIV),
    },
    "%": {
        ("int", "int"): ("int", lambda a, b: a % _zero_is_null(b)),
        ("double", "double"): ("double", lambda a, b: a % _zero_is_null(b)),
    },
}


def _pairs(a: Value, b: Value):
    for x in kinds(a):
        for y in kinds(b):
            if x == "double" and y == "int" or x == "int" and y == "double":
                yield x, y, ("double", "double")
            else:
                yield x, y, (x, y)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """a op b. Null if the left side is null; kinds that don't go together give null."""
    if a.kind == "null":
        return literal(None)
    rules = RULES[op]
    if "text" not in (a.kind, b.kind):
        for x, y, pair in _pairs(a, b):
            if pair in rules:
                kind, f = rules[pair]
                return Value(f(as_kind(a, "double" if pair[0] == "double" else x), as_kind(b, "double" if pair[1] == "double" else y)), kind)
        return literal(None)
    out = None
    for x, y, pair in _pairs(a, b):
        if pair not in rules:
            continue
        kind, f = rules[pair]
        result = to_text(Value(f(as_kind(a, pair[0]), as_kind(b, pair[1])), kind)).column
        tests = [t for t in (is_kind(a, x), is_kind(b, y)) if t is not None]
        test = tests[0] if len(tests) == 1 else tests[0] & tests[1] if tests else F.lit(True)
        out = F.when(test, result) if out is None else out.when(test, result)
    return Value(out if out is not None else F.lit(None).cast("string"), "text")


COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _by_day(op: str, a: Value, day: dt.date) -> Value | None:
    """A datetime column against a constant day, as bounds of the column itself, which reach the files' statistics."""
    if day == dt.date.max:
        return None
    start, after = (F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz") for d in (day, day + dt.timedelta(1)))
    x = a.column
    tests = {"=": (x >= start) & (x < after), "!=": (x < start) | (x >= after), "<": x < start, "<=": x < after, ">": x >= after, ">=": x >= start}
    return Value(tests[op], "bool")


def compare(op: str, a: Value, b: Value) -> Value:
    """Datetimes, then dates, then times, then numbers, then bytes: whatever both sides are."""
    f = COMPARE[op]
    for x, y, o in ((a, b, op), (b, a, FLIPPED[op])):
        if x.kind == "datetime" and y.kind == "string" and y.is_const and not D.parse_datetime(y.const) and (day := D.parse_date(y.const)):
            if found := _by_day(o, x, day):
                return found
    if "null" in (a.kind, b.kind):
        return Value(F.lit(None).cast("boolean"), "bool")
    if a.kind == b.kind and a.kind not in ("text",):
        return Value(f(a.column, b.column), "bool")
    if "text" not in (a.kind, b.kind):
        for x, y, pair in _pairs(a, b):
            if pair[0] == pair[1] and x != "string":
                return Value(f(as_kind(a, pair[0]), as_kind(b, pair[1])), "bool")
        return Value(f(to_text(a).column, to_text(b).column), "bool")
    out = None
    for x, y, pair in _pairs(a, b):
        if pair[0] != pair[1] or x == "string":
            continue
        result = f(as_kind(a, pair[0]), as_kind(b, pair[1]))
        tests = [t for t in (is_kind(a, x), is_kind(b, y)) if t is not None]
        test = tests[0] if len(tests) == 1 else tests[0] & tests[1]
        out = F.when(test, result) if out is None else out.when(test, result)
    text = f(to_text(a).column, to_text(b).column)
    return Value(text if out is None else out.otherwise(text), "bool")


def like(a: Value, b: Value) -> Value:
    """Only a trailing % is special; anything else is equality."""
    x = to_text(a).column
    if b.is_const and isinstance(b.const, str):
        return Value(x.startswith(b.const[:-1]) if b.const.endswith("%") else x == F.lit(b.const), "bool")
    y = to_text(b).column
    return Value(F.when(y.endswith("%"), x.startswith(F.regexp_replace(y, "%$", ""))).otherwise(x == y), "bool")


def concat(a: Value, b: Value) -> Value:
    """Null only if the left side is."""
    text = "text" in (a.kind, b.kind)
    return Value(F.concat(to_text(a).column, F.coalesce(to_text(b).column, F.lit(""))), "text" if text else "string")


def order_columns(v: Value, descending: bool) -> list[Column]:
    """Sort keys: null first when ascending; text as numbers where it is numeric, before other text."""
    way = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_first())
    if v.kind != "text":
        return [way(v.column)]
    number = F.when(v.column.rlike(NUMBER_TEXT), F.trim(v.column).try_cast("double"))
    return [way(F.when(v.column.isNotNull(), number.isNull().cast("int"))), way(number), way(v.column)]
