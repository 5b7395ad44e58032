import random
from decimal import Decimal

import pytest

from quarrymill.errors import MetricError
from quarrymill.model import Analysis, Metric
from quarrymill.plans import dialect, sandbox
from quarrymill.plans.canon import sha256_of


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(1234)
    rows = [(i, rnd.choice(["EU", "US", None]), Decimal(rnd.randrange(100000)) / 100) for i in range(1, 501)]
    return spark.createDataFrame(rows, "_row bigint, region string, amount decimal(38,2)")


def run(spark, data, sql, **kw):
    return sandbox.run_one(sandbox.isolated(spark, data), Metric("m", sql), **kw)


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE data", "DELETE FROM data", "SELECT 1; SELECT 2", "INSERT INTO data VALUES (1)", "CREATE TABLE x AS SELECT 1", "SET spark.sql.ansi.enabled=false", "SELEC 1",
        "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM other", "SELECT reflect('java.lang.System', 'getenv')", "WITH t AS (SELECT 1) INSERT INTO data SELECT * FROM t",
        "SELECT (SELECT java_method('java.lang.System', 'exit', 0)) FROM data", "VALUES (1)", "", "-- only a comment", "SELECT * FROM global_temp.data", "SHOW TABLES",
        "SELECT * FROM data WHERE amount IN (SELECT count(*) FROM text.`/etc/passwd`)", "EXPLAIN SELECT 1", "SELECT * FROM read_files('/etc/passwd')", "CACHE TABLE data",
        "SELECT * FROM (SELECT * FROM json.`/tmp`) x", "SELECT try_reflect('java.lang.System', 'getenv') FROM data", "SELECT sum(if(reflect('a','b') = '', 1, 0)) FROM data",
    ],
)
def test_refused(spark, data, sql):
    with pytest.raises(MetricError):
        run(spark, data, sql)


def test_groups_add_up(spark, data):
    got = run(spark, data, "SELECT region, sum(amount) AS total FROM data GROUP BY region")
    whole = run(spark, data, "/* all */ SELECT sum(amount) FROM data;")["rows"][0][0]
    assert sum(Decimal(r[1]) for r in got["rows"]) == Decimal(whole) == sum(r.amount for r in data.collect())


def test_order_and_hash(spark, data):
    sql = "SELECT region, count(*) AS n FROM data GROUP BY region"
    assert sha256_of(run(spark, data.repartition(1), sql)) == sha256_of(run(spark, data.repartition(7), sql))
    rows = run(spark, data, "SELECT _row FROM data ORDER BY _row DESC LIMIT 3")["rows"]
    assert rows == [[500], [499], [498]]
    same = run(spark, data, 'WITH t AS (SELECT "_row" AS r FROM data) SELECT max(r) AS m FROM t')
    assert same["rows"] == [[500]]


def test_null_order_over_all_rows(spark, data, tmp_path):
    """Every row of every load has its place, nulls last or first, in Spark and by the query's SQL."""
    import duckdb

    from quarrymill import catalogue

    given = [(r._row, r._row % 3, None if r._row % 4 == 0 else r.amount) for r in data.collect()]
    spark.createDataFrame(given, "sale_row bigint, load_id bigint, amount decimal(38,2)").write.parquet(f"{tmp_path}/sales.parquet")
    want = set()
    for load in range(3):
        own = [r for r in given if r[1] == load]
        up = sorted(own, key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        down = sorted(own, key=lambda r: (r[2] is not None, -(r[2] or 0), r[0]))
        want |= {(*r, up.index(r) + 1, down.index(r) + 1) for r in own}
    got = [tuple(r) for r in catalogue.QUERIES["metric_null_order_all"](spark, str(tmp_path)).collect()]
    assert len(got) == len(given) and set(got) == want
    sales = duckdb.read_parquet(f"{tmp_path}/sales.parquet/*.parquet")  # noqa: F841
    assert set(duckdb.sql(catalogue.ORACLE["metric_null_order_all"]).fetchall()) == want


def test_limits(spark, data):
    with pytest.raises(MetricError, match="more than 10 rows"):
        run(spark, data, "SELECT _row FROM data", cap=10)
    with pytest.raises(MetricError) as e:
        run(spark, data, "SELECT CAST(region AS INT) FROM data WHERE region = 'EU'")
    assert "EU" not in str(e.value).replace("failed", "")
    with pytest.raises(MetricError):
        run(spark, data, "SELECT count(*) FROM data a JOIN data b JOIN data c JOIN data d ON a.amount + b.amount + c.amount + d.amount = -1", timeout_s=2)


def test_fit(spark, data):
    got = sandbox.fit(spark, data, Analysis((Metric("a", "SELECT sum(amount) FROM data"), Metric("b", "SELECT nothing FROM data"))))
    assert got["a"] is None and got["b"]


def test_dialect():
    q = dialect.translate("SELECT a, any_value(b) FROM data GROUP BY a QUALIFY row_number() OVER (ORDER BY a) <= 3 ORDER BY a")
    assert "QUALIFY" not in q and "any_value(b, true)" in q and q.rstrip().endswith("ORDER BY a")
    assert dialect.translate("SELECT strftime(d, '%Y-%m') FROM data") == "SELECT date_format(d, 'yyyy-MM') FROM data"
    assert dialect.translate("SELECT 'QUALIFY x' FROM data") == "SELECT 'QUALIFY x' FROM data"
