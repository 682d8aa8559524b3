"""The scalar functions and aggregates by name; each builds a Column from bound values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldt.functions import dates as D
from veldt.functions import values as V
from veldt.functions.values import Value
from veldt.plans.lexer import DialectError

#: Windows-1252 characters of the bytes 80-9F that have one; fixed values.
W1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def _null_first(v: Value, column: Column) -> Column:
    """Null where the first argument is null."""
    return F.when(V.to_text(v).column.isNotNull(), column) if v.kind != "null" else F.lit(None)


def _bytes_out(v: Value, column: Column) -> Value:
    return Value(column.cast("string"), "text" if v.kind == "text" else "string")


def _left(v: Value, n: Value) -> Value:
    """The first bytes, as LENGTH counts them."""
    return _bytes_out(v, F.substring(V.to_text(v).column.cast("binary"), F.lit(1), F.greatest(V.int_column(n).cast("int"), F.lit(0))))


def _right(v: Value, n: Value) -> Value:
    """The last bytes."""
    raw, k = V.to_text(v).column.cast("binary"), V.int_column(n).cast("int")
    return _bytes_out(v, F.substring(raw, F.greatest(F.octet_length(raw) - k + 1, F.lit(1)), F.greatest(k, F.lit(0))))


def _chr(n: Value) -> Value:
    """Empty for a number that is no code point. A byte order mark goes before, since the decoder drops one that leads."""
    x = V.int_column(n)
    code = F.lpad(F.hex(F.when(x.between(0, 0x10FFFF), x)), 8, "0")
    char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), code)), "UTF-32")
    return Value(F.coalesce(char, F.when(x.isNotNull(), F.lit(""))), "string")


def _codepoint(x: Column) -> Column:
    """-1 for the empty text, which a text that begins with the character 0 is not."""
    return F.when(x == "", F.lit(-1)).otherwise(F.ascii(x)).cast("long")


def _to_hex(n: Value) -> Value:
    x = V.int_column(n)
    digits = F.lower(F.hex(F.abs(x)))
    width = F.when(F.abs(x) < 0x100, 2).when(F.abs(x) < 0x10000, 4).otherwise(F.length(digits))
    return Value(F.concat(F.when(x < 0, F.lit("-0x")).otherwise(F.lit("0x")), F.lpad(digits, width, F.lit("0"))), "string")


def _w1252(v: Value) -> Value:
    """Text whose UTF-8 was read as Windows-1252, read anew; up to the first sequence that is no UTF-8."""
    x = V.to_text(v).column
    low = "".join(bytes([b]).decode("latin-1") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    back = F.translate(x, W1252_CHARS, low)
    one_byte = back.rlike("^[\u0000-ÿ]*$")
    raw = F.encode(F.regexp_replace(back, "[^\u0000-ÿ].*$", ""), "ISO-8859-1")
    bits = F.decode(raw, "ISO-8859-1")
    good = r"^(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})*"
    kept = F.decode(F.encode(F.regexp_extract(bits, good, 0), "ISO-8859-1"), "UTF-8")
    return Value(F.when(one_byte | x.isNotNull(), kept), "string")


def _cast_int(v: Value) -> Value:
    """Leading whole number, or the seconds of a time."""
    if v.kind in ("int", "bool", "double"):
        return Value(V.int_column(v), "int")
    if v.kind == "time":
        return Value(v.column, "int")
    x = V.to_text(v).column
    time = F.regexp_extract_all(x, F.lit(r"(\d+)"), 1)
    at = lambda k: F.coalesce(F.try_element_at(time, F.lit(k)).try_cast("long"), F.lit(0))
    number = F.coalesce(F.regexp_extract(x, r"^\s*(-?[0-9]+)", 1).try_cast("long"), F.lit(0))
    return Value(F.when(x.rlike(r"^\d+:\d{2}:\d{2}"), at(1) * 3600 + at(2) * 60 + at(3)).when(x.isNotNull(), number), "int")


def _pow(a: Value, b: Value) -> Value:
    """Exact for whole numbers, null beyond 64 bits; a negative exponent gives 0."""
    if "double" in (a.kind, b.kind):
        return Value(F.pow(V.as_kind(a, "double"), V.as_kind(b, "double")), "double")
    x, n = V.int_column(a), V.int_column(b)
    one = F.lit(1).cast("long")
    fold = F.aggregate(F.array_repeat(x, F.least(F.greatest(n, F.lit(0)), F.lit(63)).cast("int")), one, F.try_multiply)
    steady = F.when(n == 0, one).when(x == -1, 1 - 2 * (n % 2)).otherwise(x)
    return Value(F.when(n < 0, F.lit(0).cast("long")).when(x.between(-1, 1), steady).when(n <= 63, fold), "int")


def _date_shift(sign: int):
    def shift(d: Value, n: Value) -> Value:
        return Value(F.date_add(V.date_column(d), (V.int_column(n) * sign).cast("int")), "date")

    return shift


def _make_date(y: Value, m: Value | None = None, d: Value | None = None) -> Value:
    part = lambda v, k: F.lpad((V.int_column(v) if v else F.lit(1)).cast("string"), k, "0")
    return Value(F.try_to_date(F.concat_ws("-", part(y, 4), part(m, 2), part(d, 2)), "yyyy-MM-dd"), "date")


def _make_time(*parts: Value) -> Value:
    h, m, s = [V.int_column(p) for p in parts] + [F.lit(0)] * (3 - len(parts))
    return Value(h * 3600 + m * 60 + s, "time")


def _make_datetime(*parts: Value) -> Value:
    given = [V.int_column(p).cast("int") for p in parts]
    y, mo, d, h, mi, s = given + [F.lit(x) for x in (1, 1, 1, 0, 0, 0)[len(given) :]]
    return Value(F.try_make_timestamp_ntz(y, mo, d, h, mi, s.cast("decimal(8,6)")), "datetime")


def _date_of(v: Value) -> Value:
    """The date of a datetime; null of anything else."""
    return Value(V.datetime_column(v).cast("date") if v.kind != "date" else F.lit(None).cast("date"), "date")


def _time_of(v: Value) -> Value:
    return Value(F.date_format(V.datetime_column(v), "HH:mm:ss") if v.kind != "date" else F.lit(None).cast("string"), "string")


def _fold(op: str):
    def fold(first: Value, *rest: Value) -> Value:
        for v in rest:
            first = V.arithmetic(op, first, v)
        return first

    return fold


def _chars(f: Callable[[Column], Column], kind: str):
    return lambda v: Value(f(V.to_text(v).column), kind)


SCALARS: dict[str, Callable[..., Value]] = {
    "ADD": _fold("+"),
    "SUB": _fold("-"),
    "MUL": _fold("*"),
    "DIV": _fold("/"),
    "MOD": _fold("%"),
    "POW": _pow,
    "RANDOM": lambda: Value(F.floor(F.rand() * 2147483647).cast("long"), "int"),
    "CHR": _chr,
    "CODEPOINT": _chars(_codepoint, "int"),
    "TO_HEX": _to_hex,
    "HEX": _chars(lambda x: F.hex(x.cast("binary")), "string"),
    "W1252": _w1252,
    "LENGTH": _chars(lambda x: F.octet_length(x).cast("long"), "int"),
    "LEFT": _left,
    "RIGHT": _right,
    "CAST_INT": _cast_int,
    "CAST_DURATION": lambda v: Value(_cast_int(v).column, "time"),
    "DATE_ADD": _date_shift(1),
    "DATE_SUB": _date_shift(-1),
    "DATE_DIFF": lambda a, b: Value(F.datediff(V.date_column(a), V.date_column(b)).cast("long"), "int"),
    "TODAY": lambda: Value(F.current_date(), "date"),
    "NOW": lambda: Value(F.date_trunc("second", F.localtimestamp()).cast("timestamp_ntz"), "datetime"),
    "CLOCK": lambda: Value(F.date_format(F.localtimestamp(), "HH:mm:ss"), "string"),
    "DATE": _date_of,
    "TIME": _time_of,
    "MAKE_DATE": _make_date,
    "MAKE_TIME": _make_time,
    "MAKE_DATETIME": _make_datetime,
    "PK": lambda v: v,
    **{f"EXTRACT_{part}": (lambda kind, f: lambda v: Value(f(V.date_column(v)).cast("long") if kind == "int" else f(V.date_column(v)), kind))(kind, f) for part, (kind, f) in D.PARTS.items()},
}


def scalar(name: str, args: list[Value]) -> Value:
    if name not in SCALARS:
        raise DialectError(f"no function {name}")
    if args and args[0].kind == "null":
        return V.literal(None)
    try:
        return SCALARS[name](*args)
    except TypeError as error:
        raise DialectError(f"{name} does not take {len(args)} arguments") from error


AGGREGATES = ("COUNT", "MIN", "MAX", "SUM", "AVG", "LISTAGG")


def _numbers(x: Column) -> tuple[Column, Column, Column]:
    """Of text: whole numbers, numbers, and whether a value is a number that is not whole."""
    clean = F.trim(x)
    return F.when(x.rlike(V.INT_TEXT), clean.try_cast("long")), F.when(x.rlike(V.NUMBER_TEXT), clean.try_cast("double")), x.rlike(r"\.")


def aggregate(name: str, v: Value | None, condition: Column | None, order: Column | None = None) -> Value:
    """An aggregate; v is None for COUNT(*). The FILTER condition takes other rows out of any aggregate."""
    keep = (lambda c: F.when(condition, c)) if condition is not None else (lambda c: c)
    if v is None:
        return Value(F.count(keep(F.lit(1))), "int", aggregate=True)
    x = v.column.cast("long") if v.kind == "bool" else v.column
    x = keep(x)
    if name == "COUNT":
        return Value(F.count(x), "int", aggregate=True)
    if name == "LISTAGG":
        text = keep(V.to_text(v).column)
        if order is not None:
            rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t")))))
            joined = F.concat_ws(",", F.transform(rows, lambda r: r["t"]))
        else:
            joined = F.concat_ws(",", F.array_sort(F.collect_list(text)))
        return Value(F.when(F.count(text) > 0, joined), "text" if v.kind == "text" else "string", aggregate=True)
    if v.kind == "null":
        return Value(F.max(F.lit(None).cast("string")), "null", aggregate=True)
    if v.kind != "text":
        if name in ("MIN", "MAX"):
            return Value((F.min if name == "MIN" else F.max)(x), "int" if v.kind == "bool" else v.kind, aggregate=True)
        if v.kind == "string":
            x = x.try_cast("double")
        kind = "int" if v.kind in ("int", "bool") else v.kind if v.kind == "time" else "double"
        return Value(F.sum(x), kind, aggregate=True) if name == "SUM" else Value(F.avg(x), "double", aggregate=True)
    whole, number, broken = _numbers(x)
    all_numbers = F.count(number) == F.count(x)
    as_text = lambda c: V.to_text(Value(c, "double")).column
    if name in ("MIN", "MAX"):
        f = F.min if name == "MIN" else F.max
        return Value(F.when(all_numbers, as_text(f(number))).otherwise(f(x)), "text", aggregate=True)
    fractions = F.coalesce(F.max(broken.cast("int")), F.lit(0)) == 1
    if name == "SUM":
        return Value(F.when(fractions, as_text(F.sum(number))).otherwise(F.sum(whole).cast("string")), "text", aggregate=True)
    n = F.count(number)
    mean = F.floor(F.abs(F.sum(whole)) / F.when(n != 0, n)) * F.signum(F.sum(whole)).cast("long")
    return Value(F.when(fractions, as_text(F.avg(number))).otherwise(mean.cast("string")), "text", aggregate=True)
