"""Queries of the general data problems (rows that fail to parse, data quality profile) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.operators import quality, rejects
from quarrymill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every faulty record of the whole table with its reasons."""
    return rejects.rejected_rows(rejects.load_records(table(spark, d, "sales_raw")))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid records as typed rows."""
    return rejects.valid_rows(rejects.load_records(table(spark, d, "sales_raw")))


def p1_file_summary(spark: SparkSession, d: str) -> DataFrame:
    return rejects.file_summary(rejects.load_records(table(spark, d, "sales_raw")))


PROFILED = ("order_id", "customer_email", "region", "amount", "order_date", "paid")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads that stand apart from the first load of their source, per column and finding."""
    return quality.LoadQuality(table(spark, d, "sales"), table(spark, d, "loads")).findings()


def p4_found_tested(spark: SparkSession, d: str) -> DataFrame:
    """The findings of p4_found, each with the classifier's figures for its column."""
    return quality.LoadQuality(table(spark, d, "sales"), table(spark, d, "loads")).report()


def p4_tests(spark: SparkSession, d: str) -> DataFrame:
    """The classifier two-sample test of every load: cross-fitted discrimination and its loss without each column."""
    return quality.LoadQuality(table(spark, d, "sales"), table(spark, d, "loads")).tests()


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column of every load."""
    return quality.profile(table(spark, d, "sales"), PROFILED)


QUERIES = {
    "p1_found": p1_found,
    "p1_loaded": p1_loaded,
    "p1_file_summary": p1_file_summary,
    "p4_found": p4_found,
    "p4_found_tested": p4_found_tested,
    "p4_tests": p4_tests,
    "p4_profile": p4_profile,
}

_WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in rejects.WHITESPACE) + ")"


def _per_delim(template: str) -> str:
    one = lambda d: template.replace("@", d)
    return f"CASE delim WHEN ';' THEN {one(';')} WHEN chr(9) THEN {one(chr(92) + 't')} ELSE {one(',')} END"


_CELL = r"(?:\"(?:[^\"]|\"\")*\"|[^\"@][^@]*|)".replace(r"\"", '"')
_P1 = f"""
WITH sound AS (
    SELECT row_no, file_name, delim, line,
        {_per_delim(f"regexp_full_match(line, '(?s){_CELL}(?:@{_CELL})*')")} AS ok,
        {_per_delim(f"regexp_extract_all(concat(line, delim), '(?s)({_CELL})@', 1)")} AS raw
    FROM sales_raw
), cells AS (
    SELECT row_no, file_name, ok, len(raw) AS n,
        list_transform(raw, lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, {_WS})) AS c
    FROM sound
), typed AS (
    SELECT *,
        CASE WHEN regexp_full_match(c[1], '[+]?[1-9][0-9]{{0,18}}') THEN try_cast(c[1] AS BIGINT) END AS order_id,
        CASE WHEN regexp_full_match(c[4], '([+]?(0|[1-9][0-9]{{0,35}})([.][0-9]{{1,2}}0*)?)|(-0([.]0+)?)')
             THEN try_cast(c[4] AS DECIMAL(38, 2)) END AS amount,
        CASE WHEN regexp_full_match(c[5], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND c[5] >= '0001'
             THEN try_cast(c[5] AS DATE) END AS order_date
    FROM cells
), judged AS (
    SELECT *, CASE WHEN NOT ok THEN ['quoting'] WHEN n <> 6 THEN ['column_count'] ELSE list_filter([
        CASE WHEN order_id IS NULL THEN 'order_id' END, CASE WHEN amount IS NULL THEN 'amount' END,
        CASE WHEN order_date IS NULL THEN 'order_date' END], lambda x: x IS NOT NULL) END AS reasons
    FROM typed
)
"""
ORACLE = {
    "p1_found": _P1 + "SELECT row_no, unnest(reasons) AS reason FROM judged",
    "p1_loaded": _P1
    + """SELECT row_no, file_name, order_id, nullif(c[2], '') AS customer_email, nullif(c[3], '') AS region, amount, order_date,
        CASE WHEN lower(c[6]) IN ('true', 't', 'yes', 'y', '1') THEN true
             WHEN lower(c[6]) IN ('false', 'f', 'no', 'n', '0') THEN false END AS paid
        FROM judged WHERE len(reasons) = 0""",
    "p1_file_summary": _P1
    + """SELECT file_name, count(*) AS records, count(*) FILTER (len(reasons) = 0) AS loaded,
        count(*) FILTER (len(reasons) > 0) AS rejected, """
    + ", ".join(
        f"count(*) FILTER (list_contains(reasons, '{r}')) AS bad_{r}"
        for r in ("quoting", "column_count", "order_id", "amount", "order_date")
    )
    + " FROM judged GROUP BY file_name",
}


def _shares(column: str) -> str:
    return f"""
    SELECT o.load_id, '{column}' AS column_name, 'distribution' AS finding FROM (
        SELECT v.load_id, sum(abs(coalesce(a.n, 0) * t.bn::HUGEINT - coalesce(b.n, 0) * t.an::HUGEINT)) AS gap, any_value(t.an) AS an, any_value(t.bn) AS bn
        FROM (SELECT DISTINCT p.load_id, p.first_load, x.{column} AS v FROM pairs p JOIN sales x ON x.load_id IN (p.load_id, p.first_load) WHERE x.{column} IS NOT NULL) v
        LEFT JOIN (SELECT load_id, {column} AS v, count(*) AS n FROM sales GROUP BY ALL) a ON a.load_id = v.load_id AND a.v = v.v
        LEFT JOIN (SELECT load_id, {column} AS v, count(*) AS n FROM sales GROUP BY ALL) b ON b.load_id = v.first_load AND b.v = v.v
        JOIN (SELECT p.load_id, a.c AS an, b.c AS bn FROM pairs p JOIN (SELECT load_id, count({column}) AS c FROM sales GROUP BY 1) a USING (load_id)
              JOIN (SELECT load_id, count({column}) AS c FROM sales GROUP BY 1) b ON b.load_id = p.first_load) t ON t.load_id = v.load_id
        GROUP BY v.load_id) o WHERE gap * 20 > an::HUGEINT * bn * 6"""


_TOTALS = """
WITH pairs AS (
    SELECT load_id, first_load FROM (SELECT load_id, min(load_id) OVER (PARTITION BY source) AS first_load FROM loads) WHERE load_id <> first_load
), totals AS (
    SELECT load_id, count(*) AS n, count(*) - count(amount) AS no_amount, count(*) - count(region) AS no_region, count(*) - count(paid) AS no_paid,
        count(*) FILTER (amount < 0) AS below, count(*) FILTER (region NOT IN ('EU', 'US', 'APAC')) AS odd_region, count(DISTINCT amount) AS amounts
    FROM sales GROUP BY load_id
), beside AS (
    SELECT t.*, f.n AS f_n, f.no_amount AS f_no_amount, f.no_region AS f_no_region, f.no_paid AS f_no_paid, f.amounts AS f_amounts, p.first_load
    FROM pairs p JOIN totals t USING (load_id) JOIN totals f ON f.load_id = p.first_load
)
"""
ORACLE["p4_found"] = (
    _TOTALS
    + " UNION ALL ".join(
        [
            f"SELECT load_id, '{c}' AS column_name, 'null_rate' AS finding FROM beside WHERE abs(no_{c}::HUGEINT * f_n - f_no_{c}::HUGEINT * n) * 10 > n::HUGEINT * f_n"
            for c in ("amount", "region", "paid")
        ]
        + [
            "SELECT load_id, 'amount', 'out_of_limits' FROM totals WHERE below * 50 > n - no_amount",
            "SELECT load_id, 'region', 'out_of_limits' FROM totals WHERE odd_region * 50 > n - no_region",
            "SELECT load_id, 'amount', 'distinct' FROM beside WHERE n > no_amount AND f_n > f_no_amount AND 2 * amounts::HUGEINT * (f_n - f_no_amount) < f_amounts::HUGEINT * (n - no_amount)",
            _shares("region"),
            _shares("paid"),
            """SELECT DISTINCT load_id, 'amount', 'distribution' FROM (
                SELECT load_id, an, bn, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM (
                    SELECT p.load_id, x.amount, any_value(p.n - p.no_amount) AS an, any_value(p.f_n - p.f_no_amount) AS bn,
                        count(*) FILTER (x.load_id = p.load_id) AS a, count(*) FILTER (x.load_id = p.first_load) AS b
                    FROM beside p JOIN sales x ON x.load_id IN (p.load_id, p.first_load) WHERE x.amount IS NOT NULL GROUP BY p.load_id, x.amount)
                WINDOW w AS (PARTITION BY load_id ORDER BY amount))
            WHERE an > 0 AND bn > 0 AND abs(ca * bn::HUGEINT - cb * an::HUGEINT) * 5 > an::HUGEINT * bn""",
        ]
    )
)
_PROFILE = {
    "order_id": ("min(order_id)::DECIMAL(38,2)::VARCHAR", "max(order_id)::DECIMAL(38,2)::VARCHAR", "order_id < 1"),
    "customer_email": ("min(customer_email)", "max(customer_email)", f"NOT regexp_full_match(customer_email, '{quality.EMAIL}')"),
    "region": ("min(region)", "max(region)", "region NOT IN ('EU', 'US', 'APAC')"),
    "amount": ("min(amount)::VARCHAR", "max(amount)::VARCHAR", "amount < 0"),
    "order_date": ("min(order_date)::VARCHAR", "max(order_date)::VARCHAR", "false"),
    "paid": ("min(paid)::VARCHAR", "max(paid)::VARCHAR", "false"),
}
ORACLE["p4_profile"] = " UNION ALL ".join(
    f"SELECT load_id, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, "
    f"{low} AS lowest, {high} AS highest, count(*) FILTER ({bad}) AS outside_schema FROM sales GROUP BY load_id"
    for c, (low, high, bad) in _PROFILE.items()
)
