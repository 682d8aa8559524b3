"""Output formats, the command line, the REPL and streams."""

import io
import json

import pytest

from veldt import cli, sinks
from veldt.session import Engine
from veldt.streaming import register_stream, start

QUERY = "VALUES (5, 'bob, thanks', 'a|b'), (-1, 'say \"hi\"', NULL), (7, 'x\ny', '<&>')"


@pytest.fixture(scope="module")
def bound(spark):
    return Engine(spark).run(QUERY)


def text(bound, form, headers=True):
    return "".join(sinks.render(bound, form, headers))


def test_csv(bound):
    assert text(bound, "csv") == 'col1,col2,col3\n5,"bob, thanks",a|b\n-1,"say ""hi""",\n7,"x\ny",<&>\n'
    assert text(bound, "csv", False).startswith("5,")
    assert text(bound, "csv:excel").startswith("﻿col1")
    assert text(bound, "tsv").splitlines()[3] == "7\tx y\t<&>"


def test_json(bound):
    assert json.loads(text(bound, "json"))[1] == {"col1": -1, "col2": 'say "hi"', "col3": None}
    assert json.loads(text(bound, "json:array"))[0] == ["col1", "col2", "col3"]


def test_flat_json(spark):
    one = Engine(spark).run("FROM SEQUENCE LIMIT 3 SELECT value AS _")
    assert json.loads(text(one, "json:array")) == [0, 1, 2]
    assert "<row>1</row>" in text(one, "xml")


def test_markup(bound):
    assert "&lt;&amp;&gt;" in text(bound, "html") and 'style="text-align:right">5' in text(bound, "html")
    assert 'col3="&lt;&amp;&gt;"' in text(bound, "xml")
    lines = text(bound, "table").splitlines()
    assert lines[0] == "| col1               | col2               | col3               |" and lines[2].startswith("|                  5 |") and "a\\|b" in lines[2] and "x␊y" in lines[4]
    assert text(bound, "box").count("│") == 4 * 4


def test_sql(bound):
    assert text(bound, "sql:values") == "VALUES\n(5,'bob, thanks','a|b'),\n(-1,'say \"hi\"',NULL),\n(7,'x\ny','<&>');\n"
    assert text(bound, "sql").startswith('INSERT INTO "table" ("col1","col2","col3") VALUES')
    assert text(bound, "sql:create").startswith('CREATE TABLE "table" ("col1" TEXT')
    assert text(bound, "record").startswith("\x01col1\x1fcol2\x1fcol3\x025\x1f")


def test_unknown_format(bound):
    with pytest.raises(ValueError):
        sinks.render(bound, "png")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(tmp_path)
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert cli.main(["-F", "csv", "-o", "out.csv", "--stats", "FROM t WHERE a > 1"]) == 0
    assert (tmp_path / "out.csv").read_text() == "a,b\n2,y\n" and "execute" in (tmp_path / "stats.csv").read_text()
    (tmp_path / "q.sql").write_text("FROM stdin SELECT b")
    assert cli.main(["-f", "q.sql", "-N", "-i", "t.csv", "-o", "two.csv"]) == 0
    assert (tmp_path / "two.csv").read_text() == "x\ny\n"
    assert cli.main(["-0", "CREATE TABLE z AS FROM t"]) == 1
    assert "read-only" in capsys.readouterr().err
    assert cli.main(["--ast", "SELECT 1 + a FROM t"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["items"][0]["expr"]["op"] == "+"


def test_repl(spark):
    out = io.StringIO()
    repl = cli.Repl(Engine(spark), "csv", out)
    for line in ("SELECT 1 AS a", ".format tsv", "SELECT 2 AS b", ".version", "FROM nowhere", ".help"):
        assert not repl.onecmd(line)
    assert repl.onecmd(".exit")
    got = out.getvalue()
    assert "a\n1\n" in got and "b\n2\n" in got and "no table nowhere" in got and ".format" in got


def test_stream(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 2 AS parity").write.parquet(str(tmp_path / "in"))
    engine = Engine(spark)
    register_stream(engine, "numbers", spark.readStream.schema("id long, parity long").parquet(str(tmp_path / "in")))
    q = start(engine, "FROM numbers WHERE id > 3 GROUP BY parity SELECT parity, COUNT(*) AS n", name="parities", mode="complete")
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("parities").collect())) == [(0, 3), (1, 3)]
