"""Queries over the driver's tables, one per operator family of the engine, with equivalent SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import coerce, plain
from quarrymill.functions.text import shape
from quarrymill.model import ROW, Column, Policy, Schema, get_policy, schema_from_dict
from quarrymill.operators import infer, joins, profile, validate
from quarrymill.operators.validate import PROBLEM
from quarrymill.plans import mapping, outputs, sandbox
from quarrymill.session import scratch_path, table
from quarrymill.sources.registry import read_source, read_table
from quarrymill.streaming import inbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- coercion: the same texts are made on both sides by a rule on the key -------------------------------------------------


def _case(key: str, n: int, texts: dict[int, str], other: str) -> str:
    return f"CASE {key} % {n} " + " ".join(f"WHEN {k} THEN {t}" for k, t in texts.items()) + f" ELSE {other} END"


_INT = _case("o_orderkey", 11, {0: "concat('00', CAST(o_orderkey AS STRING))", 1: "concat('+', CAST(o_orderkey AS STRING))", 2: "'1.0'", 3: "'1e3'", 4: "'9223372036854775808'", 5: "'-9223372036854775808'", 6: "''"}, "CAST(o_orderkey AS STRING)")


def _sql_type(s: str) -> str:
    return s.replace("AS STRING", "AS VARCHAR")


@query(f"""
SELECT o_orderkey, CASE WHEN error IS NULL THEN try_cast(t AS BIGINT) END AS value, error FROM (SELECT o_orderkey, t, CASE
    WHEN NOT regexp_full_match(t, '[+-]?[0-9]+') THEN '{plain.BAD_INTEGER}'
    WHEN regexp_matches(t, '^[+-]?0[0-9]') THEN '{plain.ZEROS_INTEGER.replace("'", "''")}'
    WHEN try_cast(t AS BIGINT) IS NULL THEN '{plain.WIDE_INTEGER}' END AS error FROM (SELECT o_orderkey, {_sql_type(_INT)} AS t FROM orders))""")
def coerce_integer_strict(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.expr(_INT).alias("t"))
    return x.select("o_orderkey", coerce.integer(F.col("t")).alias("p")).select("o_orderkey", "p.value", "p.error")


_DEC = _case("l_orderkey", 9, {0: "concat(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), '00')", 1: "concat(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), '5')", 2: "concat('0', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING))", 3: "'12,50'", 4: "'.5'", 5: "concat('-', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING))"}, "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)")


@query(f"""
SELECT l_orderkey, l_linenumber, CASE WHEN error IS NULL THEN CAST(t AS DECIMAL(38,2)) END AS value, error FROM (SELECT l_orderkey, l_linenumber, t, CASE
    WHEN NOT regexp_full_match(t, '[+-]?[0-9]+([.][0-9]+)?') THEN '{plain.BAD_DECIMAL}'
    WHEN regexp_matches(t, '^[+-]?0[0-9]') THEN '{plain.ZEROS_DECIMAL.replace("'", "''")}'
    WHEN len(rtrim(regexp_extract(t, '[.]([0-9]+)$', 1), '0')) > 2 THEN '{plain.FINE_DECIMAL.format(2)}' END AS error
    FROM (SELECT l_orderkey, l_linenumber, {_sql_type(_DEC)} AS t FROM lineitem))""")
def coerce_decimal_scale(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_DEC).alias("t"))
    return x.select("l_orderkey", "l_linenumber", coerce.decimal(F.col("t"), 2).alias("p")).select("l_orderkey", "l_linenumber", "p.value", "p.error")


_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"
_DATE = _case("o_orderkey", 8, {0: "concat(substr({d}, 1, 8), '31')", 1: "concat(substr({d}, 1, 5), '2-30')", 2: "'03/04/2026'", 3: "concat(substr({d}, 1, 4), '-1-5')", 4: "'0000-01-01'"}, "{d}")


@query(f"""
SELECT o_orderkey, CASE WHEN error IS NULL THEN CAST(t AS DATE) END AS value, error FROM (SELECT o_orderkey, t, CASE
    WHEN NOT regexp_full_match(t, '[0-9]{{4}}-(1[0-2]|0?[1-9])-([12][0-9]|3[01]|0?[1-9])') OR t < '0001' OR try_cast(t AS DATE) IS NULL THEN '{plain.BAD_DATE.format("%Y-%m-%d")}'
    WHEN len(t) <> 10 THEN '{plain.LOOSE_DATE.format("%Y-%m-%d")}' END AS error
    FROM (SELECT o_orderkey, {_DATE.format(d="strftime(o_orderdate, '%Y-%m-%d')")} AS t FROM orders))""")
def coerce_date_iso(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.expr(_DATE.format(d=_DAY)).alias("t"))
    return x.select("o_orderkey", coerce.date(F.col("t"), "%Y-%m-%d").alias("p")).select("o_orderkey", "p.value", "p.error")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS value, NULL::VARCHAR AS error FROM orders")
def coerce_date_format(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("t"))
    return x.select("o_orderkey", coerce.date(F.col("t"), "%d/%m/%Y").alias("p")).select("o_orderkey", "p.value", "p.error")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS value FROM orders")
def coerce_date_month_name(spark, d):
    """A format with a month's name takes the vectorised Python path."""
    x = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd MMM yyyy").alias("t"))
    return x.select("o_orderkey", coerce.date(F.col("t"), "%d %b %Y").alias("p")).select("o_orderkey", "p.value")


_BOOL = _case("event_id", 12, {k: f"'{t}'" for k, t in enumerate(("true", "T", "YES", "y", "1", "false", "f", "No", "N", "0", "maybe"))}, "'2'")


@query(f"""SELECT event_id, CASE WHEN lower(t) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(t) IN ('false', 'f', 'no', 'n', '0') THEN false END AS value,
    CASE WHEN lower(t) NOT IN ('true', 't', 'yes', 'y', '1', 'false', 'f', 'no', 'n', '0') THEN '{plain.BAD_BOOLEAN}' END AS error
    FROM (SELECT event_id, {_BOOL} AS t FROM events)""")
def coerce_boolean_tokens(spark, d):
    x = table(spark, d, "events").select("event_id", F.expr(_BOOL).alias("t"))
    return x.select("event_id", coerce.boolean(F.col("t")).alias("p")).select("event_id", "p.value", "p.error")


# --- validation -----------------------------------------------------------------------------------------------------------


def _schema(*columns: dict, tokens: list[str] | None = None) -> Schema:
    return schema_from_dict({"columns": list(columns), "null_tokens": tokens if tokens is not None else [""]})


BUSINESS, LOW = get_policy("business"), get_policy("low")


def _issues(raw: DataFrame, schema: Schema, policy: Policy = LOW) -> DataFrame:
    return validate.issues(validate.validate(raw, schema, policy)).select(F.col(ROW).alias("row_id"), F.col("column").alias("column_name"), "rule", "message", "value")


_SEG = "CASE WHEN c_custkey % 7 = 0 THEN 'NA' WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END"


@query(f"SELECT c_custkey AS row_id, 'segment' AS column_name, 'required' AS rule, 'required value is missing' AS message, NULL::VARCHAR AS value FROM (SELECT c_custkey, {_SEG} AS s FROM customer) WHERE s IN ('NA', '')")
def null_tokens_required(spark, d):
    raw = read_table(table(spark, d, "customer").withColumn("segment", F.expr(_SEG)).select("c_custkey", "segment"), "c_custkey")
    return _issues(raw, _schema({"name": "segment", "type": "string", "required": True}, tokens=["", "NA"]))


@query("""SELECT p_partkey AS row_id, 'p_size' AS column_name, CASE WHEN p_size < 5 THEN 'min' ELSE 'max' END AS rule,
    CASE WHEN p_size < 5 THEN 'below minimum 5' ELSE 'above maximum 40' END AS message, p_size::VARCHAR AS value FROM part WHERE p_size < 5 OR p_size > 40""")
def rule_min_max(spark, d):
    return _issues(read_table(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey"), _schema({"name": "p_size", "type": "integer", "min": 5, "max": 40}))


@query("SELECT o_orderkey AS row_id, 'o_orderstatus' AS column_name, 'allowed' AS rule, 'value is not in the allowed list' AS message, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def rule_allowed(spark, d):
    return _issues(read_table(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey"), _schema({"name": "o_orderstatus", "type": "string", "allowed": ["F", "O"]}))


@query("""SELECT p_partkey AS row_id, 'p_name' AS column_name, 'max_length' AS rule, 'longer than 6 characters' AS message,
    CASE WHEN len(p_name) > 40 THEN concat(p_name[1:37], '...') ELSE p_name END AS value FROM part WHERE len(p_name) > 6""")
def rule_length(spark, d):
    return _issues(read_table(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey"), _schema({"name": "p_name", "type": "string", "max_length": 6}))


@query("""SELECT p_partkey AS row_id, 'p_brand' AS column_name, 'pattern' AS rule, 'does not match the required pattern' AS message, p_brand AS value
    FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]*')""")
def rule_pattern(spark, d):
    return _issues(read_table(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey"), _schema({"name": "p_brand", "type": "string", "pattern": "Brand#[1-3][0-9]*"}))


@query(f"""SELECT sale_row AS row_id, 'customer_email' AS column_name, 'pattern' AS rule, 'does not match the required pattern' AS message, '{validate.MASKED}' AS value
    FROM sales WHERE NOT regexp_full_match(customer_email, '[^@\\s]+@[^@\\s]+\\.[A-Za-z]{{2,}}')""")
def rule_pattern_python(spark, d):
    """A pattern with shorthand classes is matched by Python's rules."""
    raw = read_table(table(spark, d, "sales").select("sale_row", "customer_email"), "sale_row")
    return _issues(raw, _schema({"name": "customer_email", "type": "string", "pii": True, "pattern": r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}"}), BUSINESS)


@query("""SELECT sale_row AS row_id, members, first_row FROM (SELECT sale_row, order_id, count(*) OVER w AS members, min(sale_row) OVER w AS first_row
    FROM sales WINDOW w AS (PARTITION BY order_id)) WHERE order_id IS NOT NULL AND members > 1""")
def duplicate_groups_all_members(spark, d):
    sales = table(spark, d, "sales").select(F.col("sale_row").alias(ROW), "order_id")
    groups = validate.duplicate_groups(sales, ["order_id"])
    return sales.join(groups, "order_id").select(F.col(ROW).alias("row_id"), "members", "first_row")


@query("SELECT members, first_row, md5(text) AS digest FROM (SELECT text, count(*) AS members, min(doc_id) AS first_row FROM documents GROUP BY text) WHERE members > 1")
def duplicate_first_row(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias(ROW), F.md5("text").alias("digest"))
    return validate.duplicate_groups(docs, ["digest"]).select("members", "first_row", "digest")


@query("""SELECT sale_row AS row_id, 'order_id' AS column_name, 'unique' AS rule, concat('value occurs in ', n, ' rows') AS message, order_id::VARCHAR AS value
    FROM (SELECT sale_row, order_id, count(*) OVER (PARTITION BY order_id) AS n FROM sales) WHERE n > 1 AND order_id IS NOT NULL""")
def rule_unique(spark, d):
    raw = read_table(table(spark, d, "sales").select("sale_row", "order_id"), "sale_row")
    return _issues(raw, _schema({"name": "order_id", "type": "integer", "unique": True}))


#: An empty text is a null token of the schema.
_SALES = "(SELECT * REPLACE (nullif(region, '') AS region) FROM sales)"
SALES = {
    "columns": [
        {"name": "order_id", "type": "integer", "required": True, "min": 1},
        {"name": "customer_email", "type": "string", "pii": True, "max_length": 60},
        {"name": "region", "type": "string", "required": True, "allowed": ["EU", "US", "APAC"]},
        {"name": "amount", "type": "decimal", "scale": 2, "required": True, "min": 0},
        {"name": "order_date", "type": "date", "required": True},
        {"name": "paid", "type": "boolean", "required": True},
    ]
}
_BAD = """((order_id IS NULL OR order_id < 1)::INT + coalesce(len(customer_email) > 60, false)::INT + (region IS NULL OR region NOT IN ('EU', 'US', 'APAC'))::INT
    + (amount IS NULL OR amount < 0)::INT + (order_date IS NULL)::INT + (paid IS NULL)::INT)"""


def _sales(spark, d, policy: Policy = LOW) -> DataFrame:
    raw = read_table(table(spark, d, "sales").select("sale_row", *(c["name"] for c in SALES["columns"])), "sale_row")
    return validate.validate(raw, schema_from_dict(SALES), policy)


@query(f"SELECT count(*) AS total, count(*) FILTER (bad = 0) AS valid, count(*) FILTER (bad > 0) AS quarantined, count(*) FILTER (bad > 0)::DOUBLE / count(*) AS error_rate FROM (SELECT {_BAD} AS bad FROM {_SALES})")
def quarantine_split_counts(spark, d):
    return validate.summary(_sales(spark, d))


@query(f"""SELECT * FROM (SELECT 'required' AS rule, sum((order_id IS NULL)::INT + (region IS NULL)::INT + (amount IS NULL)::INT + (order_date IS NULL)::INT + (paid IS NULL)::INT)::BIGINT AS n FROM {_SALES}
    UNION ALL SELECT 'min', count(*) FILTER (order_id < 1) + count(*) FILTER (amount < 0) FROM {_SALES}
    UNION ALL SELECT 'allowed', count(*) FROM {_SALES} WHERE region NOT IN ('EU', 'US', 'APAC')
    UNION ALL SELECT 'max_length', count(*) FROM {_SALES} WHERE len(customer_email) > 60) WHERE n > 0""")
def issues_by_rule(spark, d):
    return validate.counts_by_rule(_sales(spark, d))


@query(f"""SELECT p.policy, p.max_error_rate, r.rate AS error_rate, r.rate > p.max_error_rate OR (p.blocks AND r.rate > 0) AS blocked
    FROM (VALUES ('low', 1.0::DOUBLE, false), ('business', 0.05::DOUBLE, false), ('regulated', 0.0::DOUBLE, true)) p(policy, max_error_rate, blocks),
    (SELECT count(*) FILTER (bad > 0)::DOUBLE / count(*) AS rate FROM (SELECT {_BAD} AS bad FROM {_SALES})) r""")
def error_rate_by_policy(spark, d):
    tiers = [(n, get_policy(n).max_error_rate, get_policy(n).row_errors == "block") for n in ("low", "business", "regulated")]
    rate = validate.summary(_sales(spark, d)).select("error_rate")
    # three fixed rows beside a single one
    three = rate.select("error_rate", F.inline(F.array(*(F.struct(F.lit(a).alias("policy"), F.lit(b).alias("max_error_rate"), F.lit(c).alias("blocks")) for a, b, c in tiers))))
    return three.select("policy", "max_error_rate", "error_rate", ((F.col("error_rate") > F.col("max_error_rate")) | (F.col("blocks") & (F.col("error_rate") > 0))).alias("blocked"))


@query(f"""SELECT sale_row AS row_id, order_id::VARCHAR AS order_id, CASE WHEN customer_email IS NOT NULL THEN '{validate.MASKED}' END AS customer_email, region,
    amount::VARCHAR AS amount, order_date::VARCHAR AS order_date, paid::VARCHAR AS paid FROM sales WHERE {_BAD} = 0""")
def masked_export(spark, d):
    return outputs.clean_cells(_sales(spark, d, BUSINESS), schema_from_dict(SALES), BUSINESS).withColumnRenamed(ROW, "row_id")


@query("""SELECT sale_row AS row_id, order_id::VARCHAR AS order_id, CASE WHEN regexp_matches(customer_email, '^[=@\\t\\r]') OR (regexp_matches(customer_email, '^[+-]')
    AND NOT regexp_full_match(customer_email, '[+-][0-9 ()./-]*')) THEN concat(chr(39), customer_email) ELSE customer_email END AS customer_email, region,
    amount::VARCHAR AS amount, order_date::VARCHAR AS order_date, paid::VARCHAR AS paid FROM sales WHERE """ + _BAD + " = 0")
def clean_cells(spark, d):
    return outputs.clean_cells(_sales(spark, d), schema_from_dict(SALES), LOW).withColumnRenamed(ROW, "row_id")


@query("""SELECT buyer_id, CASE WHEN regexp_matches(notes, '^[=@\\t\\r]') OR (regexp_matches(notes, '^[+-]') AND NOT regexp_full_match(notes, '[+-][0-9 ()./-]*'))
    THEN concat(chr(39), notes) ELSE notes END AS notes FROM buyers""")
def formula_guard(spark, d):
    return table(spark, d, "buyers").select("buyer_id", coerce.formula_guard(F.col("notes")).alias("notes"))


@query(f"""SELECT sale_row AS row_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN order_id < 1 OR amount < 0 THEN 'min' END,
    CASE WHEN region NOT IN ('EU', 'US', 'APAC') THEN 'allowed' END, CASE WHEN len(customer_email) > 60 THEN 'max_length' END,
    CASE WHEN order_id IS NULL OR region IS NULL OR amount IS NULL OR order_date IS NULL OR paid IS NULL THEN 'required' END], lambda x: x IS NOT NULL))), ';') AS rules,
    array_to_string(list_filter([CASE WHEN order_id IS NULL THEN 'order_id: required value is missing' WHEN order_id < 1 THEN 'order_id: below minimum 1' END,
    CASE WHEN len(customer_email) > 60 THEN 'customer_email: longer than 60 characters' END,
    CASE WHEN region IS NULL THEN 'region: required value is missing' WHEN region NOT IN ('EU', 'US', 'APAC') THEN 'region: value is not in the allowed list' END,
    CASE WHEN amount IS NULL THEN 'amount: required value is missing' WHEN amount < 0 THEN 'amount: below minimum 0' END,
    CASE WHEN order_date IS NULL THEN 'order_date: required value is missing' END, CASE WHEN paid IS NULL THEN 'paid: required value is missing' END],
    lambda x: x IS NOT NULL), ' | ') AS messages FROM {_SALES} WHERE {_BAD} > 0""")
def quarantine_messages(spark, d):
    return outputs.quarantine_rows(_sales(spark, d), schema_from_dict(SALES), LOW).select(F.col("row").alias("row_id"), "rules", "messages")


# --- profile, inference, drift ---------------------------------------------------------------------------------------------


def _profiled(spark, d, name: str, order: str, *columns: dict) -> tuple[DataFrame, Schema]:
    schema = _schema(*columns)
    df = table(spark, d, name)
    return df.select(F.col(order).alias(ROW), *(F.col(c.name).cast(c.spark_type) for c in schema.columns)), schema


@query("""SELECT 'l_orderkey' AS column_name, count(*) AS row_count, count(*) - count(l_orderkey) AS null_count, count(DISTINCT l_orderkey) AS distinct_count, min(l_orderkey)::VARCHAR AS lowest, max(l_orderkey)::VARCHAR AS highest, sum(l_orderkey)::VARCHAR AS total FROM lineitem
    UNION ALL SELECT 'l_quantity', count(*), count(*) - count(q), count(DISTINCT q), min(q)::VARCHAR, max(q)::VARCHAR, sum(q)::VARCHAR FROM (SELECT l_quantity::DECIMAL(38,2) AS q FROM lineitem)
    UNION ALL SELECT 'l_discount', count(*), count(*) - count(q), count(DISTINCT q), min(q)::VARCHAR, max(q)::VARCHAR, sum(q)::VARCHAR FROM (SELECT l_discount::DECIMAL(38,2) AS q FROM lineitem)
    UNION ALL SELECT 'l_shipdate', count(*), count(*) - count(q), count(DISTINCT q), min(q)::VARCHAR, max(q)::VARCHAR, NULL FROM (SELECT l_shipdate::DATE AS q FROM lineitem)
    UNION ALL SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), count(DISTINCT l_returnflag), NULL, NULL, NULL FROM lineitem""")
def profile_columns(spark, d):
    data, schema = _profiled(spark, d, "lineitem", "l_orderkey", {"name": "l_orderkey", "type": "integer"}, {"name": "l_quantity", "type": "decimal", "scale": 2}, {"name": "l_discount", "type": "decimal", "scale": 2}, {"name": "l_shipdate", "type": "date"}, {"name": "l_returnflag", "type": "string"})
    got = profile.sql_profile(data, schema, LOW)
    return got.toDF("column_name", "row_count", "null_count", "distinct_count", "lowest", "highest", "total")


@query("SELECT 'o_orderkey' AS column_name, count(*) AS row_count, 0::BIGINT AS mismatches FROM orders UNION ALL SELECT 'o_totalprice', count(*), 0 FROM orders UNION ALL SELECT 'o_orderdate', count(*), 0 FROM orders")
def profile_reconciled(spark, d):
    """Both statistics paths over the same columns; a disagreement shows as a mismatch."""
    data, schema = _profiled(spark, d, "orders", "o_orderkey", {"name": "o_orderkey", "type": "integer"}, {"name": "o_totalprice", "type": "decimal", "scale": 2}, {"name": "o_orderdate", "type": "date"})
    got, wrong = profile.reconcile(data, schema, LOW)
    rows = [(p["column"], p["rows"], sum(w.startswith(p["column"] + ".") for w in wrong)) for p in got]
    return spark.createDataFrame(rows, "column_name string, row_count bigint, mismatches bigint")


@query("""SELECT * FROM (VALUES ('buyer_id', 'integer'), ('email', 'string'), ('preference_score', 'decimal'), ('last_purchase_date', 'date'), ('newsletter', 'boolean'), ('country', 'string')) t(source, type)""")
def infer_types(spark, d):
    raw = read_table(table(spark, d, "buyers").select("buyer_id", "email", "preference_score", "last_purchase_date", "newsletter", "country"), "buyer_id")
    return infer.type_column(infer.column_facts(raw)).select("source", "type")


@query("SELECT 'order_id' AS source, count(*) AS total, count(*) - count(order_id) AS missing FROM sales UNION ALL SELECT 'region', count(*), count(*) - count(nullif(region, '')) FROM sales UNION ALL SELECT 'amount', count(*), count(*) - count(amount) FROM sales")
def infer_missing(spark, d):
    raw = read_table(table(spark, d, "sales").select("sale_row", "order_id", "region", "amount"), "sale_row").drop("sale_row")
    return infer.column_facts(raw).select("source", "total", "missing")


@query("SELECT * FROM (VALUES ('missing', 'order_no'), ('extra', 'paid'), ('extra', 'load_id'), ('extra', 'loaded_at'), ('extra', 'sale_row'), ('extra', 'order_id'), ('extra', 'customer_email')) t(kind, name)")
def drift_missing_extra(spark, d):
    schema = _schema({"name": "order_no", "type": "integer"}, {"name": "region", "type": "string"}, {"name": "amount", "type": "decimal"}, {"name": "order_date", "type": "date"})
    missing, extra = infer.drift(schema, table(spark, d, "sales").columns)
    return spark.createDataFrame([("missing", x) for x in missing] + [("extra", x) for x in extra], "kind string, name string")


# --- metrics: the SQL runs in the sandbox over a table named data ------------------------------------------------------------


def metric(name: str, source: str, sql: str, oracle: str | None = None) -> None:
    """A metric as a query: checked like any metric, then returned as a frame."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        data = table(spark, d, source)
        session = sandbox.isolated(spark, data)
        frame = session.sql(sandbox.check(session, sql))
        jvm = spark.sparkContext._jvm
        return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, frame._jdf.queryExecution().analyzed()), spark)

    QUERIES[name] = run
    ORACLE[name] = (oracle or sql).replace("FROM data", f"FROM {source}").replace("JOIN data", f"JOIN {source}")


metric("metric_group_sum", "sales", "SELECT region, sum(amount) AS total, count(*) AS n, min(amount) AS low, max(amount) AS high FROM data GROUP BY region")
metric("metric_filter_count", "sales", "SELECT region, count(*) FILTER (WHERE paid) AS paid, count(*) FILTER (WHERE NOT paid) AS unpaid FROM data GROUP BY 1")
metric("metric_ratio", "sales", "SELECT region, round(100.0 * CAST(count(*) FILTER (WHERE paid) AS DOUBLE) / count(*), 2) AS paid_percent FROM data GROUP BY region")
metric("metric_avg_round", "lineitem", "SELECT l_returnflag, round(avg(l_extendedprice), 2) AS mean_price FROM data GROUP BY l_returnflag")
metric("metric_count_distinct", "events", "SELECT event_type, count(DISTINCT user_id) AS users FROM data GROUP BY event_type")
metric("metric_month_bucket", "orders", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM data GROUP BY 1 ORDER BY 1")
metric("metric_topk_per_group", "customer", "SELECT c_mktsegment, c_custkey, c_acctbal FROM data QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
metric("metric_topk_grouped", "part", "SELECT p_type, p_brand, sum(p_size) AS total FROM data GROUP BY p_type, p_brand QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY sum(p_size) DESC, p_brand) <= 2", "SELECT p_type, p_brand, sum(p_size)::BIGINT AS total FROM data GROUP BY p_type, p_brand QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY sum(p_size) DESC, p_brand) <= 2")
metric("metric_two_level_cte", "events", "WITH u AS (SELECT user_id, count(*) AS n, any_value(event_type) AS one FROM data GROUP BY user_id) SELECT n, count(*) AS users, count(one) AS typed FROM u GROUP BY n")
metric("metric_case_order", "orders", "SELECT o_orderstatus, count(*) AS n FROM data GROUP BY 1 ORDER BY CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END")
metric("metric_null_order", "sales", "SELECT amount, sale_row FROM data WHERE load_id = 1 ORDER BY amount ASC NULLS LAST, sale_row LIMIT 50")
metric("metric_null_order_all", "sales", "SELECT sale_row, load_id, amount, CAST(row_number() OVER (PARTITION BY load_id ORDER BY amount ASC NULLS LAST, sale_row) AS BIGINT) AS place, CAST(row_number() OVER (PARTITION BY load_id ORDER BY amount DESC NULLS FIRST, sale_row) AS BIGINT) AS place_down FROM data")
metric("metric_formula_check", "lineitem", "SELECT count(*) AS n, count(*) FILTER (WHERE abs(CAST(l_quantity AS DOUBLE) * l_extendedprice * (1 - l_discount)) > 100000) AS big FROM data WHERE l_returnflag IN ('A', 'R') AND l_tax IS NOT NULL")
metric("stated_vs_actual", "sales", "SELECT region, paid, count(*) AS n, count(customer_email) AS with_email FROM data WHERE paid <> false OR amount < 10 GROUP BY region, paid")
metric("window_running", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM data")
metric("window_lag", "events", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM data")
metric("window_rank", "customer", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM data WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
metric("window_frame_values", "events", "SELECT event_id, first_value(value) OVER w AS first_v, last_value(value) OVER w AS last_v, max(value) OVER w AS top FROM data WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
_SUMS = "CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS qty, count(*) AS n"
metric("agg_grouping_sets", "lineitem", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM data GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
metric("agg_cube", "lineitem", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM data GROUP BY CUBE (l_returnflag, l_linestatus)")
metric("agg_rollup", "lineitem", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM data GROUP BY ROLLUP (l_returnflag, l_linestatus)")
metric("metric_having", "events", "SELECT user_id, count(*) AS n FROM data GROUP BY ALL HAVING count(*) > 60")
metric("metric_subquery", "orders", "SELECT o_orderkey FROM data WHERE o_totalprice > (SELECT avg(o_totalprice) FROM data) AND o_custkey IN (SELECT o_custkey FROM data WHERE o_orderstatus = 'P')")
metric("metric_self_join", "events", "SELECT a.event_id, count(*) AS later FROM data a JOIN data b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts GROUP BY a.event_id")


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0")
def join_inner(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0")
    return c.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))  # aggregated below the join: fewer rows are shuffled
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0")
def join_right(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    return s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT n_name, s_suppkey FROM nation FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON n_nationkey = s_nationkey")
def join_full(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    return table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "full").select("n_name", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 45")
    return table(spark, d, "part").join(big, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""SELECT a.event_id, count(*) AS n FROM events a JOIN (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 3600 AS e FROM events WHERE event_type = 'purchase') b
    ON a.user_id = b.user_id AND epoch_us(a.ts) // 1000000 >= b.s AND epoch_us(a.ts) // 1000000 < b.e GROUP BY a.event_id""")
def join_theta_range(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("s"), (F.col("t") + 3600).alias("e"))
    return joins.interval_join(e.select("event_id", "user_id", "t"), spans, ["user_id"], "t", "s", "e", 3600).groupBy("event_id").agg(F.count("*").alias("n"))


@query("""SELECT a.event_id, b.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN
    (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def join_asof(spark, d):
    e = table(spark, d, "events")
    left, right = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return joins.asof_join(left, right, ["user_id"], "ts", ["value"], bucket=F.to_date("ts")).select("event_id", "asof_value")


@query("SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@query(r"""SELECT shape, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]+', 'a+', 'g'), '[A-Z]+', 'A+', 'g'), '[0-9]{9}', '9{9}') AS shape FROM customer) GROUP BY shape""")
def shape_signature(spark, d):
    return table(spark, d, "customer").select(shape(F.col("c_name")).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


@query("""SELECT 'amount' AS source, 'amount' AS target, count(amount) AS non_null, 1.0::DOUBLE AS parse_rate, round(count(DISTINCT amount) / count(amount), 4)::DOUBLE AS distinct_ratio FROM sales
    UNION ALL SELECT 'amount', 'order_id', count(amount), round(count(*) FILTER (regexp_matches(amount::VARCHAR, 'xx')) / count(amount), 4), round(count(DISTINCT amount) / count(amount), 4) FROM sales""")
def evidence_parse_rate(spark, d):
    raw = read_table(table(spark, d, "sales").select("sale_row", "amount"), "sale_row").select(ROW, PROBLEM, "amount")
    pairs = [("amount", Column("amount", "decimal", scale=2)), ("amount", Column("order_id", "integer"))]
    rows = [(s, c.name, e["non_null"], float(e["parse_rate"]), float(e["distinct_ratio"])) for (s, c), e in zip(pairs, mapping.evidence(raw, pairs))]
    return spark.createDataFrame(rows, "source string, target string, non_null bigint, parse_rate double, distinct_ratio double")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256(text) AS digest FROM documents GROUP BY text")
def hash_key_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_events FROM events GROUP BY ALL")
def tumbling_day_counts(spark, d):
    return inbox.day_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def top_k_per_group(spark, d):
    o = table(spark, d, "orders")
    return joins.top_k(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).select("o_orderpriority", "o_orderkey", "o_totalprice", "rank")


@query("SELECT b.buyer_id, b.country, count(*) AS orders, sum(s.amount) AS total FROM (SELECT email, min(buyer_id) AS buyer_id, min(country) AS country FROM buyers WHERE email IS NOT NULL GROUP BY email) b JOIN sales s ON s.customer_email = b.email GROUP BY 1, 2")
def sales_by_buyer(spark, d):
    """Sales are added up per address before the join: an account with a tenth of all rows is one row of it."""
    buyers = table(spark, d, "buyers").where("email IS NOT NULL").groupBy("email").agg(F.min("buyer_id").alias("buyer_id"), F.min("country").alias("country"))
    sums = table(spark, d, "sales").groupBy("customer_email").agg(F.count("*").alias("n"), F.sum("amount").alias("t"))
    both = buyers.join(sums, F.col("email") == F.col("customer_email"))
    return both.groupBy("buyer_id", "country").agg(F.sum("n").alias("orders"), F.sum("t").cast("decimal(38,2)").alias("total"))


@query()
def name_scores(spark, d):
    from quarrymill.functions.text import name_score

    names = table(spark, d, "sales").columns
    pairs = [(s, t, name_score(s, t)) for s in ("Order No", "Buyer Email", "Area", "Total (EUR)", "Ordered On", "Paid?") for t in names]
    return spark.createDataFrame(pairs, "source string, target string, score double")


# --- sources: files are written into the shared folder and read back by the engine's readers --------------------------------


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


def _one_file(df: DataFrame, ending: str, form: str, **options) -> str:
    """A table as a single file on the shared folder; for readers that take one file, which a driver opens by its path."""
    import glob

    folder = scratch_path(df.sparkSession, "file")
    df.coalesce(1).write.options(**options).format(form).save(folder)
    local = folder.removeprefix("file://")
    (part,) = glob.glob(f"{local}/part-*")
    os.rename(part, f"{local}/data{ending}")
    return f"{local}/data{ending}"


@query("SELECT row_number() OVER (ORDER BY sale_row) AS row_id, sale_row::VARCHAR AS sale_row, nullif(trim(region), '') AS region, amount::VARCHAR AS amount, paid::VARCHAR AS paid FROM sales")
def source_csv(spark, d):
    """Sales as a CSV file without quotes, read by all tasks: records are numbered in file order and cells are stripped. An empty cell stands for null here."""
    rows = _texts(table(spark, d, "sales").select("sale_row", "region", "amount", "paid").orderBy("sale_row"))
    raw, _ = read_source(spark, _one_file(rows.na.fill(""), ".csv", "csv", header=True, emptyValue="", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return raw.select(F.col(ROW).alias("row_id"), "sale_row", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in ("region", "amount", "paid")))


@query("SELECT buyer_id::VARCHAR AS buyer_id, count(*) AS n, md5(string_agg(n, '|' ORDER BY n)) AS notes FROM (SELECT buyer_id, trim(coalesce(notes, '')) AS n FROM buyers) GROUP BY buyer_id")
def source_csv_quoted(spark, d):
    """Buyers as a CSV file with quotes, delimiters and line ends inside cells."""
    rows = table(spark, d, "buyers").select(F.col("buyer_id").cast("string").alias("buyer_id"), F.coalesce(F.trim("notes"), F.lit("")).alias("notes"))
    raw, _ = read_source(spark, _one_file(rows, ".csv", "csv", header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    whole = F.array_join(F.sort_array(F.collect_list(F.trim("notes"))), "|")  # a few rows a buyer
    return raw.groupBy("buyer_id").agg(F.count("*").alias("n"), F.md5(whole).alias("notes"))


@query("SELECT row_number() OVER (ORDER BY event_id) AS row_id, event_id::VARCHAR AS event_id, event_type, props ->> 'k' AS k FROM events")
def source_json_lines(spark, d):
    """Events as JSON Lines with a nested object, flattened to dotted names."""
    rows = table(spark, d, "events").orderBy("event_id").select("event_id", "event_type", F.struct(F.get_json_object("props", "$.k").alias("k")).alias("props"))
    raw, _ = read_source(spark, _one_file(rows, ".jsonl", "json", ignoreNullFields=False))
    return raw.select(F.col(ROW).alias("row_id"), "event_id", "event_type", F.col("`props.k`").alias("k"))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def source_sql_dump(spark, d):
    """Nations as a dump of SQL statements."""
    rows = table(spark, d, "nation").select(F.format_string("INSERT INTO nation VALUES(%d,'%s');", "n_nationkey", "n_name").alias("value"))  # a fixed list
    begin = spark.createDataFrame([("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT);",)], "value string")
    raw, _ = read_source(spark, _one_file(begin.union(rows), ".sql", "text"))
    return raw.select("n_nationkey", "n_name")


@query(f"""SELECT sale_row AS row_id, 'amount' AS column_name, 'type' AS rule, '{plain.BAD_DECIMAL}' AS message, t AS value FROM (SELECT sale_row, CASE WHEN sale_row % 9 = 0 THEN amount::VARCHAR || ' EUR'
    WHEN sale_row % 10 = 0 THEN concat('1,', sale_row) ELSE amount::VARCHAR END AS t FROM sales) WHERE t LIKE '% EUR' OR t LIKE '1,%'""")
def type_issues(spark, d):
    """Cells that are no decimals."""
    text = F.expr("CASE WHEN sale_row % 9 = 0 THEN concat(CAST(amount AS string), ' EUR') WHEN sale_row % 10 = 0 THEN concat('1,', sale_row) ELSE CAST(amount AS string) END")
    return _issues(read_table(table(spark, d, "sales").select("sale_row", text.alias("amount")), "sale_row"), _schema({"name": "amount", "type": "decimal", "scale": 2}))


@query("SELECT region, paid::VARCHAR AS paid FROM sales WHERE amount IS NOT NULL AND region IS NOT NULL AND region <> '' AND paid IS NOT NULL AND amount >= 0")
def personal_columns_pruned(spark, d):
    """What metrics see where the policy masks: the personal columns are gone. Here the buyer's address and the amount are personal."""
    schema = _schema(
        {"name": "customer_email", "type": "string", "pii": True}, {"name": "amount", "type": "decimal", "scale": 2, "pii": True, "required": True, "min": 0},
        {"name": "region", "type": "string", "required": True}, {"name": "paid", "type": "boolean", "required": True},
    )
    raw = read_table(table(spark, d, "sales").select("sale_row", *(c.name for c in schema.columns)), "sale_row")
    seen = validate.engine_table(validate.validate(raw, schema, BUSINESS), schema, BUSINESS).drop(ROW)
    return seen.select(*(F.col(c).cast("string").alias(c) for c in seen.columns))


@query("SELECT text, refused FROM (VALUES " + ", ".join(f"('{t}', {r})" for t, r in (
    ("SELECT count(*) FROM data", "false"), ("WITH a AS (SELECT 1 AS x) SELECT x FROM a", "false"), ("SELECT * FROM other", "true"), ("DROP TABLE data", "true"),
    ("SELECT 1; SELECT 2", "true"), ("INSERT INTO data VALUES (1)", "true"), ("SELECT * FROM range(3)", "false"), ("SELECT java_method(1, 2) FROM data", "true"),
)) + ") t(text, refused)")
def sandbox_refusals(spark, d):
    """Which statements a metric may consist of."""
    from quarrymill.errors import MetricError

    texts = (
        "SELECT count(*) FROM data", "WITH a AS (SELECT 1 AS x) SELECT x FROM a", "SELECT * FROM other", "DROP TABLE data", "SELECT 1; SELECT 2", "INSERT INTO data VALUES (1)",
        "SELECT * FROM range(3)", "SELECT java_method(1, 2) FROM data",
    )
    session = sandbox.isolated(spark, table(spark, d, "sales"))

    def refused(text: str) -> bool:
        try:
            sandbox.check(session, text)
        except MetricError:
            return True
        return False

    return spark.createDataFrame([(t, refused(t)) for t in texts], "text string, refused boolean")


_SHAPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[0-9]', '#', 'g'), '[a-z]+', 'a+', 'g'), '[A-Z]+', 'A+', 'g'), '#', '9', 'g')"


@query(f"""SELECT shape, count(*) AS n FROM (SELECT regexp_replace(regexp_replace({_SHAPED.format(c="o_orderpriority")}, '9999', '9{{4}}'), '(^|[^9])99([^9]|$)', '\1' || '9{{2}}' || '\2', 'g') AS shape FROM orders) GROUP BY shape
    UNION ALL SELECT regexp_replace(regexp_replace(strftime(o_orderdate, '%Y-%m-%d'), '^[0-9]{{4}}', '9{{4}}'), '-[0-9]{{2}}', '-9{{2}}', 'g'), count(*) FROM orders GROUP BY 1""")
def shape_signatures(spark, d):
    """Shapes of priorities (words, blanks, single digits) and of dates (runs of digits and marks)."""
    o = table(spark, d, "orders")
    texts = o.select(F.col("o_orderpriority").alias("t")).union(o.select(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return texts.select(shape(F.col("t")).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))
