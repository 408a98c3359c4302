"""Each query that SQL can express, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    frame = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    given = [d[0] for d in result.description]
    assert sorted(given) == columns
    places = [given.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in places) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == expected


def test_sequential_ids_past_the_width_of_a_number(spark, tmp_path):
    """From the ten thousandth row of a source on lpad cuts the number, as the SQL has it."""
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT i AS doc_id, CASE WHEN i % 20 = 0 THEN NULL WHEN i % 20 = 1 THEN 'b' ELSE 'a' END AS source FROM range(11300) r(i)) TO '{tmp_path}/documents.parquet'")
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    expected = sorted(duck.execute(__spark_entry__.oracle_sql()["f7_sequential_ids"]).fetchall())
    assert sorted((r.doc_id, r.source, r.key) for r in __spark_entry__.queries()["f7_sequential_ids"](spark, str(tmp_path)).collect()) == expected


def test_last_version_sorts_nothing(spark, duck):
    frame = __spark_entry__.queries()["h10_last_version"](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan and plan.count("Exchange") == 1


def test_rule_engine_sends_no_line_through_the_rules_and_follows_the_sql(spark, duck, tmp_path, monkeypatch):
    """Lines with other sections or none, without amount, without a part or a document; the rules see each part once for each kind of section."""
    from tallymill.plans import rule_queries

    sources = {"part": f"SELECT * FROM '{FOLDER}/part.parquet'", "orders": f"SELECT * FROM '{FOLDER}/orders.parquet' WHERE o_orderkey % 13 <> 0"}
    sources["lineitem"] = f"""SELECT * REPLACE (CASE WHEN l_linenumber % 4 = 1 THEN NULL WHEN l_linenumber % 4 = 2 THEN '-' ELSE l_returnflag END AS l_returnflag,
      CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, CASE WHEN l_partkey % 7 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS l_partkey) FROM '{FOLDER}/lineitem.parquet'"""
    odd = duckdb.connect()
    for name, sql in sources.items():
        odd.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        odd.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    seen, first_rule = [], rule_queries.patterns.first_rule
    monkeypatch.setattr(rule_queries.patterns, "first_rule", lambda rows, *given: seen.append(rows.count()) or first_rule(rows, *given))
    columns = ["document_id", "oa", "ob", "oc", "rule_id", "cma_row", "how"]
    got = __spark_entry__.queries()["i29_rule_engine"](spark, str(tmp_path)).select(*columns).collect()
    expected = odd.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()['i29_rule_engine']})").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr) and {r.how for r in got} == {"rule", "amount", "none"}
    assert seen == [5 * odd.execute("SELECT count(*) FROM part").fetchone()[0]]
