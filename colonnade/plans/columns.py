"""Column statistics and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions import aggregates as agg
from colonnade.operators import edit, profile, quantiles, statistics
from colonnade.plans.registry import query
from colonnade.table import Table, inventory

_PRICE = "l_extendedprice"


def _rounded(df, digits=6, *names):
    names = names or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({name: F.round(name, digits) for name in names})


def _numbers(table, column, names):
    """A registered statistic set: ``(statistic, value)`` of one column."""

    def plan(t):
        tall = statistics.numeric_statistics(getattr(t, table), [column], names)
        return _rounded(tall.select("statistic", "value"))

    return plan


def _union(rows):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS statistic, round(CAST({value} AS DOUBLE), 6) AS value FROM {table}"
        for table, name, value in rows
    )


query(
    "stat_basic",
    _union(
        ("customer", name, value)
        for name, value in {
            "count": "count(c_acctbal)",
            "mean": "avg(c_acctbal)",
            "sum": "round(sum(c_acctbal), 2)",
            "min": "min(c_acctbal)",
            "max": "max(c_acctbal)",
            "range": "max(c_acctbal) - min(c_acctbal)",
        }.items()
    ),
)(
    lambda t: statistics.numeric_statistics(
        t.customer, ["c_acctbal"], ["count", "mean", "sum", "min", "max", "range"]
    ).select(
        "statistic",
        F.when(F.col("statistic") == "sum", F.round("value", 2)).otherwise(F.round("value", 6)).alias("value"),
    )
)

query(
    "stat_dispersion",
    _union([("part", "stddev", "stddev_samp(p_retailprice)"), ("part", "variance", "var_samp(p_retailprice)")]),
)(_numbers("part", "p_retailprice", ["stddev", "variance"]))

query(
    "stat_coef_variation",
    _union([("lineitem", "coef_variation", f"stddev_samp({_PRICE}) / avg({_PRICE})")]),
)(_numbers("lineitem", _PRICE, ["coef_variation"]))

query(
    "stat_skew_kurt",
    _union(
        [
            ("lineitem", "skewness", f"skewness({_PRICE})"),
            ("lineitem", "kurtosis", f"kurtosis({_PRICE})"),
        ]
    ),
)(_numbers("lineitem", _PRICE, ["skewness", "kurtosis"]))

query(
    "stat_means",
    _union(
        [
            ("customer", "geometric_mean", "exp(avg(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END))"),
            ("customer", "harmonic_mean", "count(nullif(c_acctbal, 0)) / sum(1.0 / nullif(c_acctbal, 0))"),
            ("customer", "root_mean_square", "sqrt(avg(c_acctbal * c_acctbal))"),
        ]
    ),
)(_numbers("customer", "c_acctbal", ["geometric_mean", "harmonic_mean", "root_mean_square"]))


@query(
    "stat_correlation",
    "SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation, "
    "round(corr(nullif(l_discount, 0), l_tax), 6) AS with_gaps FROM lineitem",
)
def _(t):
    gaps = F.nullif(F.col("l_discount"), F.lit(0.0))
    return t.lineitem.agg(
        F.round(agg.correlation(F.col("l_quantity"), F.col(_PRICE)), 6).alias("correlation"),
        F.round(agg.correlation(gaps, F.col("l_tax")), 6).alias("with_gaps"),
    )


@query("stat_iqr", f"SELECT round(quantile_cont({_PRICE}, 0.75) - quantile_cont({_PRICE}, 0.25), 6) AS iqr FROM lineitem")
def _(t):
    return _rounded(quantiles.interquartile_range(t.lineitem, [_PRICE]).select("iqr"))


@query(
    "stat_intercentile",
    f"SELECT round((quantile_cont({_PRICE}, 0.9) - quantile_cont({_PRICE}, 0.1)) "
    f"/ abs(quantile_cont({_PRICE}, 0.5)), 6) AS ratio FROM lineitem",
)
def _(t):
    return _rounded(quantiles.intercentile_ratio(t.lineitem, [_PRICE]).select("ratio"))


@query(
    "stat_median",
    "SELECT 'l_quantity' AS \"column\", round(median(l_quantity), 6) AS median FROM lineitem "
    f"UNION ALL SELECT '{_PRICE}', round(median({_PRICE}), 6) FROM lineitem",
)
def _(t):
    return _rounded(quantiles.median(t.lineitem, ["l_quantity", _PRICE]))


_PROBABILITIES = (0.1, 0.25, 0.5, 0.75, 0.9)
_PERCENTILES = " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS p, round(quantile_cont({_PRICE}, {p}), 6) AS value FROM lineitem"
    for p in _PROBABILITIES
)


@query("stat_percentiles", _PERCENTILES)
def _(t):
    found = quantiles.quantiles(t.lineitem, [_PRICE], _PROBABILITIES)
    return found.select("p", F.round("value", 6).alias("value"))


@query("stat_percentiles_by_rank", _PERCENTILES)
def _(t):
    # The way columns too large for one task are handled.
    found = quantiles.quantiles(t.lineitem, [_PRICE], _PROBABILITIES, gathered=2000)
    return found.select("p", F.round("value", 6).alias("value"))


@query(
    "stat_mad",
    f"SELECT round(avg(abs({_PRICE} - m)), 6) AS mad FROM lineitem, (SELECT avg({_PRICE}) AS m FROM lineitem)",
)
def _(t):
    return _rounded(statistics.mean_absolute_deviation(t.lineitem, _PRICE))


def _mode_sql(table, column):
    return (
        f"SELECT {column} AS value, count(*) AS frequency FROM {table} WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY frequency DESC, value LIMIT 1"
    )


def _mode(name, table, column):
    query(name, _mode_sql(table, column))(lambda t: statistics.mode(getattr(t, table), column))


_mode("stat_mode", "lineitem", "l_quantity")
_mode("stat_date_mode", "orders", "o_orderdate")
_mode("stat_mode_text", "orders", "o_orderpriority")


@query(
    "stat_date",
    "SELECT min(o_orderdate) AS min, max(o_orderdate) AS max, median(o_orderdate) AS median FROM orders",
)
def _(t):
    return statistics.date_statistics(t.orders, "o_orderdate")


@query(
    "stat_length",
    "SELECT CAST(sum(length(text)) AS BIGINT) AS sum_length, round(avg(length(text)), 6) AS mean_length, "
    "min(length(text)) AS min_length, max(length(text)) AS max_length FROM documents",
)
def _(t):
    made = t.documents.agg(*[v.alias(k) for k, v in agg.text_length(F.col("text")).items()])
    return _rounded(made).withColumns(
        {name: F.col(name).cast("bigint") for name in ("min_length", "max_length")}
    )


@query(
    "stat_entropy",
    "SELECT round(-sum(p * log10(p)), 6) AS entropy FROM (SELECT count(*) / "
    "(SELECT CAST(count(*) AS DOUBLE) FROM part) AS p FROM part GROUP BY p_name)",
)
def _(t):
    return _rounded(statistics.entropy(t.part, "p_name"))


@query("stat_categories", "SELECT DISTINCT p_type AS category FROM part WHERE p_type IS NOT NULL")
def _(t):
    return statistics.categories(t.part, "p_type")


@query(
    "stat_has_categories",
    "SELECT count(DISTINCT o_orderpriority) AS distinct_count, count(*) AS row_count, "
    "count(DISTINCT o_orderpriority) > 0 AND count(DISTINCT o_orderpriority) < count(*) AS has_categories "
    "FROM orders",
)
def _(t):
    return statistics.has_categories(t.orders, "o_orderpriority")


@query(
    "stat_frequency",
    "SELECT p_name AS value, count(*) AS frequency FROM part WHERE p_name IS NOT NULL GROUP BY p_name",
)
def _(t):
    return statistics.frequency_distribution(t.part, "p_name")


def _tall_sql(table, columns, body):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + body.replace("$c", c) + f" FROM {table}" for c in columns
    )


_LINE_COLUMNS = ["l_orderkey", "l_discount", "l_returnflag", "l_shipdate"]


@query(
    "stat_distinct_count",
    _tall_sql(
        "lineitem",
        _LINE_COLUMNS,
        "count(*) AS row_count, count($c) AS non_null, count(DISTINCT $c) AS distinct_count",
    ),
)
def _(t):
    return statistics.distinct_counts(t.lineitem, _LINE_COLUMNS)


@query(
    "stat_cardinality_ratio",
    _tall_sql("orders", ["o_custkey", "o_orderpriority"], "round(count(DISTINCT $c) / CAST(count(*) AS DOUBLE), 6) AS ratio"),
)
def _(t):
    made = profile.column_summary(t.orders, ["o_custkey", "o_orderpriority"])
    return made.select("column", F.round("cardinality_ratio", 6).alias("ratio"))


_GAPS = "(SELECT nullif(l_discount, 0) AS l_discount, nullif(l_linestatus, 'F') AS l_linestatus, l_tax FROM lineitem)"


@query(
    "stat_nulls",
    _tall_sql(
        _GAPS,
        ["l_discount", "l_linestatus", "l_tax"],
        "count($c) AS non_null, count(*) - count($c) AS null_count, "
        "round((count(*) - count($c)) / CAST(count(*) AS DOUBLE), 6) AS null_rate",
    ),
)
def _(t):
    gaps = t.lineitem.select(
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        F.nullif(F.col("l_linestatus"), F.lit("F")).alias("l_linestatus"),
        "l_tax",
    )
    return _rounded(statistics.null_statistics(gaps, gaps.columns))


_KINDS = {
    "o_orderkey": ("INTEGER", "INTEGER"),
    "o_custkey": ("INTEGER", "INTEGER"),
    "o_orderstatus": ("STRING", "VARCHAR"),
    "o_totalprice": ("DOUBLE", "DOUBLE"),
    "o_orderdate": ("DATE", "DATE"),
    "o_orderpriority": ("STRING", "VARCHAR"),
}


@query(
    "column_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS logical_type, '{native}' AS native_type, "
        f"round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS null_rate, "
        f"count(DISTINCT {c}) AS distinct_count, "
        f"round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 6) AS cardinality_ratio FROM orders"
        for c, (kind, native) in _KINDS.items()
    ),
)
def _(t):
    return _rounded(profile.column_summary(t.orders))


_HEADER = [
    *[("o_totalprice", s, f"round({f}(o_totalprice), 2)", "NULL")
      for s, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("sum", "sum"))],
    *[("o_orderpriority", f"{s}_length", f"round({f}(length(o_orderpriority)), 2)", "NULL")
      for s, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("sum", "sum"))],
    *[("o_orderdate", s, "NULL", f"{s}(o_orderdate)") for s in ("min", "max", "median")],
]


@query(
    "column_header_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{s}' AS statistic, CAST({value} AS DOUBLE) AS value, "
        f"CAST({moment} AS TIMESTAMP) AS moment FROM orders"
        for c, s, value, moment in _HEADER
    ),
)
def _(t):
    made = profile.header_statistics(t.orders, ["o_totalprice", "o_orderpriority", "o_orderdate"])
    return _rounded(made, 2)


@query(
    "empty_columns",
    "SELECT 'l_returnflag' AS \"column\", count(l_returnflag) AS non_null FROM lineitem "
    "UNION ALL SELECT 'l_linestatus', count(nullif(l_linestatus, 'F')) FROM lineitem "
    "UNION ALL SELECT 'note', 0 FROM (SELECT count(*) FROM lineitem)",
)
def _(t):
    gaps = t.lineitem.withColumns(
        {
            "l_linestatus": F.nullif(F.col("l_linestatus"), F.lit("F")),
            "note": F.lit(None).cast("string"),
        }
    )
    return edit.empty_columns(gaps)


@query("drop_empty_columns", "SELECT l_orderkey, l_linestatus FROM lineitem")
def _(t):
    note = F.lit(None).cast("string").alias("note")
    return edit.drop_empty(t.lineitem.select("l_orderkey", note, "l_linestatus"))


_NATIVE = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"
_LOGICAL = "CASE column_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'DOUBLE' THEN 'DOUBLE' WHEN 'TIMESTAMP' THEN 'DATE' ELSE 'INTEGER' END"


_LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()


@query(
    "describe_table",
    f"SELECT CAST(d.ordinal AS INTEGER) AS ordinal, d.column_name AS \"column\", "
    f"{_NATIVE} AS spark_type, {_LOGICAL} AS logical_type, "
    "column_type <> 'VARCHAR' AND column_type <> 'TIMESTAMP' AS chart_value, "
    "column_type = 'VARCHAR' AS chart_group, true AS chart_outer, true AS filterable, n.non_null "
    "FROM (SELECT row_number() OVER () - 1 AS ordinal, * FROM (DESCRIBE lineitem)) d JOIN ("
    + _tall_sql("lineitem", _LINEITEM, "count($c) AS non_null")
    + ') n ON n."column" = d.column_name',
)
def _(t):
    table = Table.open(t.spark, t.path("lineitem"))
    counts = statistics.null_statistics(table.df, table.columns).select("column", "non_null")
    return table.describe().join(counts, "column")


_INVENTORY = {
    "customer": 5, "lineitem": 11, "nation": 3, "orders": 6, "part": 6, "region": 2, "supplier": 4,
}


@query(
    "table_inventory",
    " UNION ALL ".join(
        f"SELECT '{name}' AS alias, count(*) AS row_count, CAST({width} AS BIGINT) AS column_count FROM {name}"
        for name, width in _INVENTORY.items()
    ),
)
def _(t):
    tables = [Table(getattr(t, name), name, t.path(name)) for name in _INVENTORY]
    return inventory(t.spark, tables).select("alias", "row_count", "column_count")


_WHOLE = "CAST(l_orderkey AS BIGINT) * 1000000007 + 9007199254740993"


@query(
    "stat_whole_numbers",
    "SELECT 'big' AS \"column\", unnest(['min', 'max', 'range', 'sum']) AS statistic, unnest([lo, hi, hi - lo, total]) AS value "
    f"FROM (SELECT CAST(min({_WHOLE}) AS DECIMAL(38, 0)) AS lo, CAST(max({_WHOLE}) AS DECIMAL(38, 0)) AS hi, "
    f"CAST(sum(CAST({_WHOLE} AS HUGEINT)) AS DECIMAL(38, 0)) AS total FROM lineitem)",
)
def _(t):
    big = F.col("l_orderkey") * F.lit(1000000007) + F.lit(9007199254740993)
    return statistics.whole_statistics(t.lineitem.select(big.alias("big")), ["big"])


def _top_sql(column):
    return (
        f"SELECT {column} AS value, count(*) AS frequency FROM lineitem WHERE {column} IS NOT NULL "
        f"GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
    )


@query("stat_top_values", _top_sql("l_quantity"))
def _(t):
    return statistics.top_values(t.lineitem, "l_quantity", 20)


@query("stat_top_values_near_unique", _top_sql("l_orderkey"))
def _(t):
    return statistics.top_values(t.lineitem, "l_orderkey", 20)
