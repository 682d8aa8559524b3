"""Binds a parsed query to relations and emits DataFrame operations; Catalyst does the rest.

Every attribute gets an internal name (t0_0, t0_1, ...; outputs c0, c1, ...), so self joins, repeated names and names
with dots need no care. Names are resolved to Field nodes first; then expressions compare by value, which is how
GROUP BY expressions are found again in SELECT and ORDER BY.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions import dates as D
from veldt.functions import registry
from veldt.functions import values as V
from veldt.functions.values import Value
from veldt.operators import bounds as B
from veldt.plans import ast
from veldt.plans.lexer import DialectError
from veldt.sources import generated
from veldt.sources.relation import Relation, numbered
from veldt.sources.snapshots import snapshot

#: Output rows of a LIMIT, with those its OFFSET skips, that one task may hold and number.
WINDOW_ROWS = 100_000


@dataclass(frozen=True)
class Field:
    """An attribute by its place in the scope; or, with rowid, the row number of a source."""

    at: int
    rowid: bool = False


@dataclass
class Entry:
    source: int
    name: str
    kind: str
    column: str
    original: str  # the relation's own name of it


@dataclass
class Bound:
    """A query's result: columns c0, c1, ... with their dialect names and kinds."""

    df: DataFrame
    names: tuple[str, ...]
    kinds: tuple[str, ...]
    ordered: bool = False

    @property
    def relation(self) -> Relation:
        return Relation(self.df, self.names, self.kinds, ordered=self.ordered)


def _has(node, *names: str) -> bool:
    return any(isinstance(x, ast.Call) and x.name in names for x in ast.walk(node))


class Binder:
    def __init__(self, engine, ctes: dict | None = None):
        self.engine, self.spark, self.ctes = engine, engine.spark, dict(ctes or {})

    # Queries

    def query(self, q: ast.Query) -> Bound:
        for name, sub in q.ctes:
            self.ctes[name] = (sub, dict(self.ctes))
        sources = list(q.sources)
        if q.values is not None and not sources:
            sources = [ast.Source(None, values=q.values, alias="values")]
        everything = (q.items or (), q.where, q.group, q.order)
        if not sources and (q.items is None or any(isinstance(x, ast.Name | ast.Star) for x in ast.walk((*[i.expr for i in q.items], q.where)))):
            sources = [ast.Source("stdin")]
        self.sources, self.entries = sources, []
        named_where, index_order, copies = self._explicit_index(q.where)
        relations = [copies.get(s.name) or self.relation(s) for s in sources]
        for i, (source, relation) in enumerate(zip(sources, relations, strict=True)):
            names = list(relation.names)
            if source.columns:
                names[: len(source.columns)] = source.columns
            self.entries += [Entry(i, n, k, f"t{i}_{j}", o) for j, (n, k, o) in enumerate(zip(names, relation.kinds, relation.names, strict=True))]
        aliases = {i.alias: i.expr for i in q.items or () if i.alias and not self._spreads(i.expr)}
        where = tuple(c for p in named_where for c in ast.conjuncts(self.resolve(p, aliases, first=True)))
        on = [tuple(c for p in s.on for c in ast.conjuncts(self.resolve(p, {}, upto=i))) for i, s in enumerate(sources)]
        items = self._items(q)
        group = tuple(self.resolve(g, aliases, first=False) for g in q.group)
        order = tuple(ast.Order(self.resolve(o.expr, aliases, first=True), o.descending) for o in q.order)
        if not order and index_order:
            order = tuple(ast.Order(self.resolve(ast.Name(c), {})) for c in index_order)
        self.rowids = {x.at for x in self._fields((*[n for _, n in items], where, group, order, *on)) if x.rowid}
        self.listagg_order = None
        if relations and relations[0].generated is None and _has((*[n for _, n in items], everything), "LISTAGG") and "text" in relations[0].kinds:
            self.rowids.add(0)
            self.listagg_order = F.col("t0_rowid")
        df = self._joined(relations, where, on, q)
        for p in where:
            df = df.where(self._predicate(p))
        return self._output(df, q, items, group, order)

    @staticmethod
    def _spreads(expr) -> bool:
        """Whether an item becomes a column for each field: a star, or a function of one."""
        return isinstance(expr, ast.Star) or isinstance(expr, ast.Call) and expr.name != "COUNT" and any(isinstance(a, ast.Star) for a in expr.args)

    def _explicit_index(self, where: tuple) -> tuple[tuple, tuple[str, ...], dict[str, Relation]]:
        """INDEX('f') op v and UNIQUE('f') op v stand for the index's first column, order rows by the index, and let the
        table's sorted copy stand for it, whose statistics leave few files to read."""
        order: tuple[str, ...] = ()
        copies: dict[str, Relation] = {}

        def change(node):
            nonlocal order
            if isinstance(node, ast.Call) and node.name in ("INDEX", "UNIQUE"):
                if len(node.args) != 1 or not isinstance(node.args[0], ast.Literal):
                    raise DialectError(f"{node.name} takes the name of an index")
                name = str(node.args[0].value)
                order = self.engine.index_columns(name)
                copies.update(self.engine.index_copy(name))
                return ast.Name(order[0])
            return None

        return ast.rewrite(where, change), order, copies

    def relation(self, source: ast.Source) -> Relation:
        if source.values is not None:
            rows = [[self._constant(x) for x in row] for row in source.values]
            return generated.values(self.spark, rows)
        if source.query is not None:
            return Binder(self.engine, self.ctes).query(source.query).relation
        if source.name in self.ctes:
            query, seen = self.ctes[source.name]
            return Binder(self.engine, seen).query(query).relation
        return self.engine.relation(source.name, [self._constant(a) for a in source.args])

    def _constant(self, node):
        if isinstance(node, ast.Literal):
            return node.value
        value = B.constant(node)
        if value is None:
            raise DialectError("only constants may stand here")
        return str(value) if not isinstance(value, int | float | str) else value

    # Names

    def _matches(self, entry: Entry, name: ast.Name) -> bool:
        if entry.name != name.name:
            return False
        return name.table is None or name.table in self._source_names(entry.source)

    def _source_names(self, i: int) -> set[str]:
        s = self.sources[i]
        if s.alias:
            return {s.alias}
        if s.name is None:
            return {"subquery"}
        base = s.name.rsplit("/", 1)[-1]
        return {s.name, base, base.split(".", 1)[0], base.split(":", 1)[-1]}

    def find(self, name: ast.Name, upto: int | None = None, only: int | None = None) -> Field | None:
        """The first FROM item's column of that name."""
        for at, e in enumerate(self.entries):
            if (upto is None or e.source <= upto) and (only is None or e.source == only) and self._matches(e, name):
                return Field(at)
        if name.name == "rowid":
            for i in range(len(self.sources)):
                if (name.table is None or name.table in self._source_names(i)) and (only is None or i == only):
                    return Field(i, True)
        return None

    def resolve(self, node, aliases: dict, first: bool = False, upto: int | None = None, only: int | None = None):
        """node with its names as Fields. first: aliases go before columns (WHERE, ORDER BY), else after (GROUP BY)."""

        def change(x):
            if not isinstance(x, ast.Name):
                return None
            alias = aliases.get(x.name) if x.table is None else None
            if alias is not None and first:
                return self.resolve(alias, {})
            found = self.find(x, upto, only)
            if found is None and alias is not None:
                return self.resolve(alias, {})
            if found is None:
                raise DialectError(f"no column {x.table + '.' if x.table else ''}{x.name}")
            return found

        return ast.rewrite(node, change)

    @staticmethod
    def _fields(node):
        if isinstance(node, Field):
            yield node
        elif isinstance(node, tuple | list):
            for x in node:
                yield from Binder._fields(x)
        elif isinstance(node, ast.Scalar | ast.Query):
            return
        elif hasattr(node, "__dataclass_fields__"):
            for f in node.__dataclass_fields__:
                yield from Binder._fields(getattr(node, f))

    def _items(self, q: ast.Query) -> list[tuple[str, object]]:
        """(name, resolved expression) of each output column; stars are spread."""
        out: list[tuple[str, object]] = []
        for item in q.items if q.items is not None else (ast.Item(ast.Star(), None, "*"),):
            if isinstance(item.expr, ast.Star):
                found = [(e.name, Field(at)) for at, e in enumerate(self.entries) if item.expr.table is None or item.expr.table in self._source_names(e.source)]
                if not found:
                    raise DialectError(f"nothing in {item.expr.table or 'SELECT *'}")
                out += found
            elif self._spreads(item.expr):
                for at, e in enumerate(self.entries):
                    call = replace(item.expr, args=tuple(Field(at) if isinstance(a, ast.Star) else a for a in item.expr.args))
                    out.append(((item.alias or "") + e.name, self.resolve(call, {})))
            else:
                out.append((item.alias or item.text, self.resolve(item.expr, {})))
        return out

    # Joins

    def _joined(self, relations: list[Relation], where: tuple, on: list[tuple], q: ast.Query) -> DataFrame:
        if not relations:
            return self.spark.range(1).select(F.lit(1).alias("t_dummy"))
        df = None
        for i, (source, relation) in enumerate(zip(self.sources, relations, strict=True)):
            left = source.how == "left"
            predicates = on[i]
            if source.using is not None:
                predicates = (*predicates, self._using(source.using, i))
            if relation.generated == "calendar" and df is not None and (day := self._calendar_key(i, predicates)):
                df = self._computed_calendar(df, i, *day, predicates, left)
                continue
            inside = predicates if left else (*predicates, *where, *(p for o, s in zip(on, self.sources, strict=True) if s.how != "left" for p in o))
            if relation.generated:
                side = self._generated(i, relation, inside, q)
            else:
                names = [f"t{i}_{j}" for j in range(len(relation.names))]
                side = relation.df.toDF(*names, *[f"t{i}_rowid"] * bool(relation.rowid))
                if i in self.rowids and not relation.rowid:
                    side = numbered(side, f"t{i}_rowid", relation.ordered)
                if (relation.in_order or relation.ordered and i in self.rowids) and df is None:  # Spark leaves the sort out where a join, grouping or order follows
                    place = [f"t{i}_rowid"] if i in self.rowids else ["_metadata.file_path", "_metadata.row_index"]
                    side = side.orderBy(*map(F.col, place))
            if df is None:
                df = side
                continue
            if not predicates:
                df = df.crossJoin(side)
                continue
            condition = None
            for p in predicates:
                c = self._predicate(p)
                condition = c if condition is None else condition & c
            df = df.join(side, condition, "left" if left else "inner")
        return df

    def _using(self, expr, i: int):
        """USING e, with e a column or a function of one: e of the tables so far equals e of the new one."""
        return ast.Binary("=", self.resolve(expr, {}, upto=i - 1), self.resolve(expr, {}, only=i))

    def _generated(self, i: int, relation: Relation, predicates: tuple, q: ast.Query) -> DataFrame:
        def is_column(node):
            if isinstance(node, Field):
                if node.rowid:
                    return {"calendar": "julian", "sequence": "value"}[relation.generated] if node.at == i else None
                e = self.entries[node.at]
                return e.original if e.source == i else None
            return None

        if relation.generated == "calendar":
            b = B.calendar_bounds(predicates, is_column, self.engine.today)
            if b.low is None and b.high is None or (b.high is None or b.low is None) and q.limit is None:
                raise DialectError("CALENDAR needs bounds: predicates on its date, julian, year, ... from both sides, or one and a LIMIT")
            low = b.low if b.low is not None else D.FIRST_DAY + D.JULIAN_EPOCH
            high = b.high if b.high is not None else D.LAST_DAY + D.JULIAN_EPOCH + 1
            df = generated.calendar(self.spark, low, high)
            number = "julian"
        else:
            b = B.sequence_bounds(predicates, is_column, self.engine.today)
            if b.high is None and q.limit is None:
                raise DialectError("SEQUENCE needs an upper bound or a LIMIT")
            low = max(b.low or 0, 0)
            if b.step > 1:
                low += (b.phase - low) % b.step
            high = b.high if b.high is not None else low + max(generated.SEQUENCE_ROWS, q.offset + q.limit) * max(b.step, 1)
            df = generated.sequence(self.spark, low, high, b.step)
            number = "value"
        columns = [F.col(n).cast("long").alias(f"t{i}_{j}") if k == "int" else F.col(n).alias(f"t{i}_{j}") for j, (n, k) in enumerate(zip(relation.names, relation.kinds, strict=True))]
        if i in self.rowids:
            columns.append(F.col(number).cast("long").alias(f"t{i}_rowid"))
        return df.select(*columns)

    def _calendar_key(self, i: int, predicates: tuple):
        """(column, expression of earlier tables, predicate) of an equality with the calendar's date or julian."""
        for p in predicates:
            if not isinstance(p, ast.Binary) or p.op != "=":
                continue
            for a, b in ((p.left, p.right), (p.right, p.left)):
                if isinstance(a, Field) and not a.rowid and self.entries[a.at].source == i and self.entries[a.at].original in ("date", "julian"):
                    others = list(self._fields(b))
                    if others and all((x.at if x.rowid else self.entries[x.at].source) < i for x in others):
                        return self.entries[a.at].original, b, p
        return None

    def _computed_calendar(self, df: DataFrame, i: int, column: str, expr, key, predicates: tuple, left: bool) -> DataFrame:
        """A join with the calendar on its key needs no join: the columns are computed from the key."""
        value = self.value(expr)
        day = V.date_column(value) if column == "date" else D.date_of_julian(V.int_column(value))
        if column == "julian":
            julian = V.int_column(value)
            day = F.when(julian.between(D.FIRST_DAY + D.JULIAN_EPOCH, D.LAST_DAY + D.JULIAN_EPOCH), day)
        df = df.withColumn(f"t{i}_day", day)
        own = [(f"t{i}_{j}", kind, f) for j, (kind, f) in enumerate(D.CALENDAR.values())]
        df = df.withColumns({n: f(F.col(f"t{i}_day")).cast("long") if k == "int" else f(F.col(f"t{i}_day")) for n, k, f in own})
        if i in self.rowids:
            df = df.withColumn(f"t{i}_rowid", D.julian(F.col(f"t{i}_day")))
        rest = F.col(f"t{i}_day").isNotNull()
        for p in predicates:
            if p is not key:
                rest = rest & F.coalesce(self._predicate(p), F.lit(False))
        if not left:
            return df.where(rest)
        df = df.withColumn(f"t{i}_found", rest)
        return df.withColumns({n: F.when(F.col(f"t{i}_found"), F.col(n)) for n, _, _ in own})

    # Expressions

    def _predicate(self, node, group: dict | None = None) -> Column:
        v = self.value(node, group)
        if v.kind == "bool":
            return v.column
        return V.compare("!=", v, V.literal(0)).column

    def value(self, node, group: dict | None = None) -> Value:
        """The value of a resolved expression; group: the values of the grouping expressions, if rows are grouped."""
        if group is not None and node in group:
            return group[node]
        if isinstance(node, ast.Literal):
            return V.literal(node.value)
        if isinstance(node, Field):
            if node.rowid:
                column, kind = F.col(f"t{node.at}_rowid"), "int"
            else:
                e = self.entries[node.at]
                column, kind = F.col(e.column), e.kind
            if group is not None:
                column = F.first(column)
            return Value(column, kind)
        if isinstance(node, ast.Scalar):
            bound = Binder(self.engine, self.ctes).query(node.query)
            return Value(bound.df.select("c0").scalar(), bound.kinds[0])
        if isinstance(node, ast.Binary):
            if node.op in ("AND", "OR"):
                a, b = self._predicate(node.left, group), self._predicate(node.right, group)
                return Value(a & b if node.op == "AND" else a | b, "bool")
            a, b = self.value(node.left, group), self.value(node.right, group)
            if node.op == "||":
                return V.concat(a, b)
            if node.op == "LIKE":
                return V.like(a, b)
            return V.compare(node.op, a, b) if node.op in V.COMPARE else V.arithmetic(node.op, a, b)
        if isinstance(node, ast.Not):
            return Value(~self._predicate(node.arg, group), "bool")
        if isinstance(node, ast.Is):
            a = self.value(node.arg, group)
            if node.value == ast.Literal(None):
                empty = V.to_text(a).column.isNull()
                return Value(~empty if node.negated else empty, "bool")
            return V.compare("!=" if node.negated else "=", a, self.value(node.value, group))
        if isinstance(node, ast.Between):
            a = self.value(node.arg, group)
            low = V.compare(">=", a, self.value(node.low, group))
            high = V.compare("<" if node.open_end else "<=", a, self.value(node.high, group))
            return Value(low.column & high.column, "bool")
        if isinstance(node, ast.In):
            a, some = self.value(node.arg, group), list(dict.fromkeys(node.values))
            constants = [x.value for x in some if isinstance(x, ast.Literal)]
            plain = len(constants) == len(some) and None not in constants
            if plain and (a.kind == "string" and all(isinstance(x, str) for x in constants) or a.kind in ("int", "double") and all(isinstance(x, int | float) for x in constants)):
                return Value(a.column.isin(constants), "bool")
            tests = [V.compare("=", a, self.value(x, group)).column for x in some]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return Value(out, "bool")
        if isinstance(node, ast.Call):
            if node.name in registry.AGGREGATES:
                return self._aggregate(node)
            if node.name == "ROW_NUMBER":
                return Value(F.col("row_number"), "int")
            if node.filter is not None:
                raise DialectError(f"{node.name} takes no FILTER")
            return registry.scalar(node.name, [self.value(a, group) for a in node.args])
        raise DialectError(f"{type(node).__name__} may not stand here")

    def _aggregate(self, node: ast.Call) -> Value:
        if len(node.args) != 1:
            raise DialectError(f"{node.name} takes one argument")
        condition = self._predicate(node.filter) if node.filter is not None else None
        if isinstance(node.args[0], ast.Star):
            if node.name != "COUNT":
                raise DialectError(f"{node.name} does not take *")
            return registry.aggregate("COUNT", None, condition)
        return registry.aggregate(node.name, self.value(node.args[0]), condition, self.listagg_order)

    # Output

    def _output(self, df: DataFrame, q: ast.Query, items: list, group: tuple, order: tuple) -> Bound:
        grouped = bool(group) or _has(tuple(n for _, n in items), *registry.AGGREGATES) or _has(order, *registry.AGGREGATES)
        keys: dict | None = None
        if grouped:
            values = [self.value(g) for g in group]
            df = df.withColumns({f"g{k}": v.column for k, v in enumerate(values)}) if values else df
            keys = {g: Value(F.col(f"g{k}"), v.kind) for k, (g, v) in enumerate(zip(group, values, strict=True))}
        late = [_has(n, "ROW_NUMBER") for _, n in items]
        outputs = [None if is_late else self.value(n, keys) for (_, n), is_late in zip(items, late, strict=True)]
        shown = [None if v is None else self._shown(v) for v in outputs]
        sort_values = [(self.value(o.expr, keys), o.descending) for o in order]
        columns = [v.column.alias(f"c{k}") for k, v in enumerate(shown) if v is not None]
        sorts = [v.column.alias(f"o{k}") for k, (v, _) in enumerate(sort_values)]
        if grouped:
            by = df.groupBy(*[f"g{k}" for k in range(len(group))])
            df = by.agg(*columns, *sorts) if columns or sorts else by.agg(F.lit(1).alias("t_dummy"))
        else:
            df = df.select(*columns, *sorts) if columns or sorts else df.select(F.lit(1).alias("t_dummy"))
        keys_out = [c for k, (v, down) in enumerate(sort_values) for c in V.order_columns(replace(v, column=F.col(f"o{k}")), down)]
        if keys_out:
            df = df.orderBy(*keys_out)
        few = q.limit is not None and q.offset + q.limit <= WINDOW_ROWS
        if keys_out and q.limit is not None and not few:
            df = self._cut(self._row_numbers(df, keys_out, few), q.offset, q.limit)
        else:
            if q.offset:
                df = df.offset(q.offset)
            if q.limit is not None:
                df = df.limit(q.limit)
            if any(late):
                df = self._row_numbers(df, keys_out, few)
        if any(late):
            numbers = {k: self._shown(self.value(n, {})) for k, (_, n) in enumerate(items) if late[k]}
            shown = [numbers.get(k, v) for k, v in enumerate(shown)]
            df = df.select(*[numbers[k].column.alias(f"c{k}") if k in numbers else F.col(f"c{k}") for k in range(len(items))])
        else:
            df = df.select(*[f"c{k}" for k in range(len(items))])
        return Bound(df, tuple(n for n, _ in items), tuple(v.kind for v in shown), bool(keys_out))

    @staticmethod
    def _row_numbers(df: DataFrame, keys: list[Column], few: bool) -> DataFrame:
        """1-based numbers of output rows. A small limit leaves few rows for one task; others are written as they stand and
        numbered by file, so that no row moves and a lost executor changes nothing."""
        if few:
            order = keys or [F.monotonically_increasing_id()]
            return df.withColumn("row_number", F.row_number().over(Window.orderBy(*order)).cast("long"))
        names = df.columns
        return numbered(snapshot(df).toDF(*names), "row_number").withColumn("row_number", F.col("row_number") + 1)

    @staticmethod
    def _cut(df: DataFrame, offset: int, limit: int) -> DataFrame:
        """The rows of a large OFFSET and LIMIT by their numbers, in order: Spark's own limit of a sort would hold so many
        rows in the memory of each task."""
        kept = df.where(F.col("row_number").between(offset + 1, offset + limit))
        return kept.withColumn("row_number", F.col("row_number") - offset).orderBy("row_number")

    @staticmethod
    def _shown(v: Value) -> Value:
        if v.kind == "bool":
            return Value(v.column.cast("int"), "int")
        if v.kind in ("time", "null"):
            return V.to_text(v)
        return v
