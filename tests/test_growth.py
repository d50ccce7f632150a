"""Tables that grow with the input don't go through the driver, and no step holds a row for every pair of equal names."""

import duckdb
import pytest

from codeweave.functions import registry
from codeweave.plans import catalog, state  # noqa: F401

CLASSES = 400


@pytest.fixture(scope="module")
def one_name(spark, tmp_path_factory):
    """Classes of which most bear one name and a quarter inherit from it."""
    d = str(tmp_path_factory.mktemp("one_name"))
    spark.range(CLASSES).selectExpr("id as p_partkey", "'red plate' as p_name", "'Brand#1' as p_brand", "'SMALL' as p_type", "cast(id % 50 as int) as p_size", "1.0D as p_retailprice").write.parquet(f"{d}/part.parquet")
    return d


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_scans(df):
    """Scans below broadcasts of the plan, as their lists of columns."""
    out, depth = [], None
    for line in plan(df).splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if "BroadcastExchange" in line and depth is None:
            depth = at
        elif depth is not None and "Scan parquet" in line:
            out.append(line[line.index("Scan parquet"):].split("[")[1].split("]")[0])
    return out


def test_inherits_edges_broadcast_no_table_of_classes(spark, one_name):
    df = catalog.QUERIES["inherits_edges"](spark, one_name)
    assert "Broadcast" not in plan(df)
    assert df.filter("src like '%red plate%' and dst like '%red plate%'").count() == CLASSES // 5 * (CLASSES * 4 // 5)


def test_inherits_transitive_holds_no_row_a_pair(spark, one_name, monkeypatch):
    settled = []

    def settle(df, label, keep=catalog.settle):
        settled.append((label, plan(df), keep(df, label)))
        return settled[-1][2]

    monkeypatch.setattr(catalog, "settle", settle)
    df = catalog.QUERIES["inherits_transitive"](spark, one_name)
    assert 0 < df.count() <= CLASSES and df.distinct().count() == df.count()
    assert not [label for label, text, _ in settled if "Broadcast" in text]
    assert max(df.count() for _, _, df in settled) <= 3 * CLASSES


def test_cypher_match_broadcasts_no_table_and_carries_no_whole_properties(spark):
    from codeweave.query import cypher, sql

    df = catalog.QUERIES["cypher_match"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in plan(df)
    v = spark.createDataFrame([("x", "A", {"name": "n", "note": "long"}), ("y", "B", {"name": "m"})], "v string, label string, props map<string,string>")
    e = spark.createDataFrame([("T", "x", "y")], "etype string, src string, dst string")
    c = cypher.Compiler(v, e, "MATCH (a:A)-[:T]->(`b c`) WHERE `b c`.name = 'm' RETURN a.name, a.none, `b c`.name AS other, labels(a) AS l")
    assert [tuple(r) for r in c.run().collect()] == [("n", None, "m", "A")]
    assert not [t for _, t in c.df.dtypes if t.startswith("map")]


@pytest.mark.parametrize("kind", ["CONTAINS", "IMPORTS", "INHERITS", "IMPLEMENTS"])
def test_a_rebuilt_graph_broadcasts_only_regions_and_nations(spark, kind):
    from codeweave.plans.fixture import Fixture

    tables = catalog._rebuilt(Fixture(spark, "/root/testdata/sf0.001"))
    scans = broadcast_scans(tables["edges"].filter(f"etype = '{kind}'")) + [c for t in tables if t != "edges" for c in broadcast_scans(tables[t])]
    assert scans and {column[:2] for columns in scans for column in columns.split(",")} == {"n_", "r_"}


@pytest.fixture(scope="module")
def long_file(spark, tmp_path_factory):
    """One nation has so many customers that its file is longer than the usual limit of lines."""
    d = str(tmp_path_factory.mktemp("long_file"))
    for t in ("region", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    spark.range(registry.MAX_LINES // 3 + 100).selectExpr("id as c_custkey", "concat('c', id) as c_name", "if(id < 50, cast(id % 25 as int), 0) as c_nationkey").write.parquet(f"{d}/customer.parquet")
    spark.range(50).selectExpr("id as s_suppkey", "concat('s', id) as s_name", "cast(id % 25 as int) as s_nationkey").write.parquet(f"{d}/supplier.parquet")
    return d


def sql_rows(name, d):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    return columns, sorted(want.fetchall())


def test_parse_full_has_the_elements_of_long_files(spark, long_file):
    columns, want = sql_rows("parse_full", long_file)
    assert sorted(tuple(r) for r in catalog.QUERIES["parse_full"](spark, long_file).select(*columns).collect()) == want


def test_limits_of_content_are_options(spark):
    from codeweave.sources import tree

    files = spark.createDataFrame([(1, "java", "\n" * (registry.MAX_LINES + 1)), (2, "css", "\n"), (3, "go", "\n" * 5)], "id int, language string, content string")
    mode = lambda config: [r["mode"] for r in tree.parse_mode(files, config).orderBy("id").collect()]
    assert mode(None) == ["passthrough", "passthrough", "full"]
    assert mode(tree.Discovery.whole()) == ["full", "passthrough", "full"]
    assert mode(tree.Discovery(max_lines=4)) == ["passthrough", "passthrough", "passthrough"]


def test_parse_incremental_has_the_changes_of_long_files(spark, long_file):
    columns, want = sql_rows("parse_incremental", long_file)
    assert sorted(tuple(r) for r in catalog.QUERIES["parse_incremental"](spark, long_file).select(*columns).collect()) == want
