"""The engine: statements in, DataFrames out."""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions import values as V
from veldt.plans import ast
from veldt.plans.binder import Binder, Bound
from veldt.plans.explain import explain
from veldt.plans.lexer import DialectError, statements
from veldt.plans.parser import Parser, parse
from veldt.sources import files, generated
from veldt.sources.relation import Relation, numbered, relation_of
from veldt.sources.snapshots import new_path, snapshot


class Engine:
    """Runs the dialect on a SparkSession.

    base: the folder that file names are relative to. tables: DataFrames by name. multiline: whether line ends may
    stand in quotes of CSV files (such files can't be split); by default large files are searched for such lines first.
    read_only rejects CREATE, INSERT and DROP. stdin: the path of what the name stdin stands for.
    """

    def __init__(self, spark: SparkSession, base: str = ".", tables: dict[str, DataFrame] | None = None, *, multiline: bool | None = None, read_only: bool = False, stdin: str | None = None):
        self.spark, self.base, self.multiline, self.read_only, self.stdin = spark, base, multiline, read_only, stdin
        self.tables: dict[str, Relation] = {n: relation_of(df) for n, df in (tables or {}).items()}
        self.temp: dict[str, Relation] = {}
        self.views: dict[str, str] = {}
        self.parts: dict[str, list[str]] = {}  # the folders that hold a temporary table, in order
        self.indexes: dict[str, tuple[str, tuple[str, ...], str | None]] = {}  # table, key columns, sorted copy
        self.today = dt.datetime.now(dt.timezone.utc).date()
        self.timings: list[tuple[str, float]] = []

    @classmethod
    def over_parquet(cls, spark: SparkSession, folder: str, names: Iterable[str], **options) -> Engine:
        """An engine whose tables are Parquet files or folders; none is read before a query needs it."""
        engine = cls(spark, folder, **options)
        engine.parquet = {n: f"{folder}/{n}.parquet" for n in names}
        return engine

    parquet: dict[str, str] = {}

    # Names

    def path(self, name: str) -> str:
        return name if re.match(r"[a-z][a-z0-9+.-]*:/|/", name) else f"{self.base}/{name}"

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = relation_of(df)

    def relation(self, name: str, args: list | None = None) -> Relation:
        """Temporary tables and views, then registered tables, then files (as named, with .csv, with .sql), then built-ins
        and Spark's own catalog."""
        if args or name == "DIR":
            if name != "DIR" or len(args or []) != 1:
                raise DialectError(f"no table function {name}")
            return generated.directory(self.spark, self.path(str(args[0])))
        name = name.removeprefix("memory:")
        if name in self.temp:
            return self.temp[name]
        if name in self.views:
            return self._view(self.views[name])
        if name in self.tables:
            return self.tables[name]
        if name in self.parquet:
            self.tables[name] = relation_of(self.spark.read.parquet(self.parquet[name]))
            return self.tables[name]
        stem, _, kind = name.rpartition(".")
        if name == "stdin" or stem == "stdin":
            if self.stdin is None:
                raise DialectError("there is no stdin")
            return files.READERS[kind if stem else "csv"](self.spark, self.stdin, self.multiline)
        for full in (name, f"{name}.csv", f"{name}.sql"):
            kind = full.rpartition(".")[2]
            if kind in (*files.READERS, "sql", "parquet", "json", "orc") and files.exists(self.spark, self.path(full)):
                if kind == "sql":
                    return self._view(files.read_text(self.spark, self.path(full)))
                if kind in files.READERS:
                    return files.READERS[kind](self.spark, self.path(full), self.multiline)
                return relation_of(self.spark.read.format(kind).load(self.path(full)))
        if name == "CALENDAR":
            return generated.CALENDAR
        if name == "SEQUENCE":
            return generated.SEQUENCE
        if name == "SAMPLE":
            return relation_of(generated.sample(self.spark))
        if files.exists(self.spark, self.path(f"{name}.parquet")):
            return relation_of(self.spark.read.parquet(self.path(f"{name}.parquet")))
        if re.fullmatch(r"[\w.]+", name) and self.spark.catalog.tableExists(name):
            return relation_of(self.spark.table(name))
        raise DialectError(f"no table {name}")

    def _view(self, text: str) -> Relation:
        query = parse(text)
        if not isinstance(query, ast.Query):
            raise DialectError("a view must be a query")
        return Binder(self).query(query).relation

    def index_columns(self, name: str) -> tuple[str, ...]:
        """The key columns of an index: a created one, or those that its name tells (table__column.index)."""
        if name in self.indexes:
            return self.indexes[name][1]
        m = re.fullmatch(r".*?__(.+?)(?:\.(?:index|unique))?(?:\.csv)?", name)
        if not m:
            raise DialectError(f"no index {name}")
        return tuple(m[1].split("__"))

    def index_copy(self, name: str) -> dict[str, Relation]:
        """The table that an index is on, as the index's sorted copy with row numbers; nothing if rows came in since."""
        on, _, path = self.indexes.get(name, (None, (), None))
        if path is None:
            return {}
        table = self.relation(on)
        return {on: Relation(self.spark.read.parquet(path), table.names, table.kinds, rowid="rowid")}

    # Statements

    def sql(self, text: str) -> DataFrame | None:
        """Run all statements of a text; the last query's result, with the dialect's column names."""
        last = None
        for statement in statements(text):
            got = self.run(statement)
            last = got if got is not None else last
        return last.df.toDF(*last.names) if last else None

    def run(self, statement: str) -> Bound | None:
        start = time.perf_counter()
        if re.match(r"\s*FROM\s+INFORMATION\b", statement):
            return self._information(statement)
        node = Parser(statement).statement()
        self.timings.append(("parse", time.perf_counter() - start))
        if isinstance(node, ast.Query):
            start = time.perf_counter()
            bound = Binder(self).query(node)
            if node.explain:
                plan = explain(self.spark, bound.df)
                return Bound(plan.toDF(*[f"c{i}" for i in range(len(plan.columns))]), tuple(plan.columns), ("int", "string", "string", "string", "int", "int", "string"))
            self.timings.append(("analyse", time.perf_counter() - start))
            return bound
        if isinstance(node, ast.Lock):
            return None
        if self.read_only:
            raise DialectError("the engine is read-only")
        if isinstance(node, ast.Create):
            return self._create(node)
        if isinstance(node, ast.Insert):
            return self._insert(node)
        for place in (self.temp, self.views, self.tables, self.indexes):
            if node.name in place:
                del place[node.name]
                self._outdate(node.name)
                return None
        raise DialectError(f"nothing to drop: {node.name}")

    def _information(self, statement: str) -> Bound:
        m = re.search(r"WHERE\s+\S+\s*=\s*'([^']*)'", statement)
        if not m:
            raise DialectError("INFORMATION needs WHERE name = 'table'")
        relation = self.relation(m[1])
        if relation.df is None:
            raise DialectError(f"{m[1]} is generated")
        fields = self.spark.createDataFrame([(m[1], len(relation.names), i, n, k) for i, (n, k) in enumerate(zip(relation.names, relation.kinds, strict=True))], "c0 string, c2 int, c3 int, c4 string, c5 string")
        count = relation.df.agg(F.count(F.lit(1)).alias("c1"))  # one row
        df = fields.crossJoin(F.broadcast(count)).select(*[f"c{i}" for i in range(6)])
        return Bound(df, ("table", "records", "fields", "position", "field", "kind"), ("string", "int", "int", "int", "string", "string"))

    def _create(self, node: ast.Create) -> None:
        if node.kind == "view":
            Binder(self).query(node.query)  # a view must bind
            if node.name.endswith(".sql"):
                files.write_text(self.spark, self.path(node.name), node.text)
            else:
                self.views[node.name] = node.text
            return None
        if node.kind in ("index", "unique"):
            return self._create_index(node)
        if node.query is None and not node.columns:
            raise DialectError("CREATE TABLE needs columns or a query")
        if node.kind == "temp":
            if node.name in self.temp:
                raise DialectError(f"{node.name} exists")
            bound = self._result(node)
            self.parts[node.name] = [new_path(self.spark)]
            self.temp[node.name] = Relation(snapshot(bound.df, *self.parts[node.name]), bound.names, bound.kinds, in_order=True)
            return None
        self._write(self._result(node), node.name, "errorifexists")
        return None

    def _result(self, node: ast.Create) -> Bound:
        if node.query is None:
            empty = self.spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(len(node.columns))))
            return Bound(empty, node.columns, ("text",) * len(node.columns))
        bound = Binder(self).query(node.query)
        if node.columns:
            if len(node.columns) != len(bound.names):
                raise DialectError("the query has another number of columns")
            bound = Bound(bound.df, node.columns, bound.kinds, bound.ordered)
        return bound

    def _write(self, bound: Bound, name: str, mode: str) -> None:
        """Files by suffix (csv is the default); columns with one name are told apart by a number."""
        names, seen = [], set()
        for n in bound.names:
            while n in seen:
                n += "_"
            seen.add(n)
            names.append(n)
        full = name if name.rpartition(".")[2] in ("csv", "tsv", "parquet") and "." in name else f"{name}.csv"
        if full.endswith(".parquet"):
            bound.df.toDF(*names).write.mode(mode).parquet(self.path(full))
            return
        text = [V.to_text(V.Value(F.col(f"c{i}"), k)).column.alias(n) for i, (n, k) in enumerate(zip(names, bound.kinds, strict=True))]
        sep = "\t" if full.endswith(".tsv") else ","
        bound.df.select(*text).write.mode(mode).csv(self.path(full), header=True, sep=sep, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)

    def _insert(self, node: ast.Insert) -> None:
        bound = Binder(self).query(node.query)
        if node.name in self.temp:
            old = self.temp[node.name]
            if len(old.names) != len(bound.names):
                raise DialectError("INSERT has another number of columns")
            target = old.df.toDF(*[f"c{i}" for i in range(len(old.names))])
            new = bound.df.select(*[F.col(f"c{i}").cast(f.dataType).alias(f"c{i}") if f.dataType.typeName() != "string" else V.to_text(V.Value(F.col(f"c{i}"), bound.kinds[i])).column.alias(f"c{i}") for i, f in enumerate(target.schema.fields)])
            # only what is new is written, to a folder whose name sorts behind those of the earlier rows
            first = self.parts[node.name][0]
            self.parts[node.name].append(f"{first}_{len(self.parts[node.name]):06}")
            self.temp[node.name] = Relation(snapshot(new, *self.parts[node.name]), old.names, old.kinds, in_order=True)
            self._outdate(node.name)
            return None
        old = self.relation(node.name)
        if len(old.names) != len(bound.names):
            raise DialectError("INSERT has another number of columns")
        self._write(Bound(bound.df, old.names, bound.kinds), node.name, "append")
        self._outdate(node.name)
        return None

    def _outdate(self, table: str) -> None:
        """Indexes of a table that has new rows keep their key columns, but their copies are read no more."""
        for name, (on, columns, _) in list(self.indexes.items()):
            if on.split(".", 1)[0] == table.split(".", 1)[0]:
                self.indexes[name] = (on, columns, None)

    def _create_index(self, node: ast.Create) -> None:
        """A copy of the table sorted by the key columns, with row numbers, as Parquet: INDEX and UNIQUE read it."""
        relation = self.relation(node.on)
        if relation.df is None:
            raise DialectError(f"{node.on} is generated")
        if missing := [c for c in node.columns if c not in relation.names]:
            raise DialectError(f"no column {missing[0]}")
        keys = [F.col(f"k{relation.names.index(c)}") for c in node.columns]
        df = numbered(relation.df.toDF(*[f"k{i}" for i in range(len(relation.names))]), "rowid", relation.ordered)
        if node.kind == "unique" and not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise DialectError(f"{', '.join(node.columns)} is not unique")
        kind = "unique" if node.kind == "unique" else "index"
        name = node.name or f"{node.on.rsplit('/', 1)[-1].split('.', 1)[0]}__{'__'.join(node.columns)}.{kind}"
        path = new_path(self.spark)
        df.orderBy(*keys, "rowid").write.parquet(path)
        self.indexes[name] = (node.on, tuple(node.columns), path)
        return None
