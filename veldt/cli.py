"""Command line and REPL."""

from __future__ import annotations

import argparse
import cmd
import contextlib
import json
import os
import sys
import time

from veldt import sinks
from veldt.plans import ast
from veldt.plans.lexer import DialectError, statements
from veldt.plans.parser import parse
from veldt.session import Engine
from veldt.sources.files import write_text
from veldt.sources.snapshots import new_path

VERSION = "0.1"


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("veldt").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def show(engine: Engine, text: str, form: str, headers: bool, out) -> None:
    """Run every statement and print every query's result."""
    for statement in statements(text):
        bound = engine.run(statement)
        if bound is None:
            continue
        start = time.perf_counter()
        for piece in sinks.render(bound, form, headers):
            out.write(piece)
        engine.timings.append(("execute", time.perf_counter() - start))
    out.flush()


class Repl(cmd.Cmd):
    prompt = "> "

    def __init__(self, engine: Engine, form: str = "box", out=None):
        super().__init__(stdout=out)
        self.engine, self.form, self.explaining = engine, form, False

    def default(self, line: str):
        if line == "EOF":
            return True
        if line.startswith("."):
            return self.command(*line[1:].split())
        try:
            show(self.engine, f"EXPLAIN {line}" if self.explaining else line, self.form, True, self.stdout)
        except Exception as error:  # noqa: BLE001 - a REPL goes on
            self.stdout.write(f"{error}\n")
        return False

    def emptyline(self) -> None:
        pass

    def command(self, name: str = "help", *args: str):
        if name == "exit":
            return True
        if name == "version":
            self.stdout.write(f"{VERSION}\n")
        elif name == "format" and args and args[0] in sinks.FORMATS:
            self.form = args[0]
        elif name == "explain":
            self.explaining = args[:1] != ("off",)
        else:
            self.stdout.write(f".help .version .exit .format [{'|'.join(sinks.FORMATS)}] .explain [on|off]\n")
        return False


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veldt", description="Run queries of the dialect over text files and Parquet.")
    p.add_argument("query", nargs="*", help="the query; without one a REPL starts")
    p.add_argument("-f", "--file", help="read the query from a file, - for stdin")
    p.add_argument("-E", "--explain", action="store_true", help="show the plan instead of rows")
    p.add_argument("-H", "--headers", dest="headers", action="store_true", default=True)
    p.add_argument("-N", "--no-headers", dest="headers", action="store_false")
    p.add_argument("-F", "--format", choices=sorted(sinks.FORMATS), help="output format")
    p.add_argument("-i", "--input", help="a file that stands for stdin")
    p.add_argument("-o", "--output", help="write to a file")
    p.add_argument("--stats", action="store_true", help="write timings to stats.csv")
    p.add_argument("--ast", action="store_true", help="print the syntax tree as JSON")
    p.add_argument("-0", "--read-only", action="store_true", help="reject CREATE, INSERT and DROP")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    a = p.parse_args(argv)
    text = " ".join(a.query)
    if a.file:
        with contextlib.nullcontext(sys.stdin) if a.file == "-" else open(a.file) as f:
            text = f.read()
    if a.ast:
        print(json.dumps([ast.as_json(parse(s)) for s in statements(text)], indent=1))
        return 0
    engine = Engine(session(), os.getcwd(), read_only=a.read_only, stdin=(f"file://{os.path.abspath(a.input)}" if a.input and "://" not in a.input else a.input) or ("/dev/stdin" if text and not sys.stdin.isatty() else None))
    if engine.stdin == "/dev/stdin" and "stdin" in text:
        engine.stdin = _spooled(engine)
    form = a.format or ("box" if sys.stdout.isatty() else "csv")
    try:
        if not text:
            Repl(engine, form).cmdloop()
            return 0
        with open(a.output, "w") if a.output else contextlib.nullcontext(sys.stdout) as out:
            show(engine, "; ".join(f"EXPLAIN {s}" for s in statements(text)) if a.explain else text, form, a.headers, out)
    except DialectError as error:
        print(error, file=sys.stderr)
        return 1
    finally:
        if a.stats:
            sinks.write_stats(engine.timings, "stats.csv")
    return 0


def _spooled(engine: Engine) -> str:
    """Standard input in a file that executors can read, and more than once."""
    path = f"{new_path(engine.spark)}.txt"
    write_text(engine.spark, path, sys.stdin.read())
    return path
