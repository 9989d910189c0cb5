"""Grouped sub-tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import filters as flt
from colonnade.operators.subtable import subtable
from colonnade.plans.registry import query


@query(
    "subtable",
    "SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum, "
    "round(avg(l_extendedprice), 4) AS l_extendedprice_avg, round(sum(l_tax), 2) AS l_tax_sum "
    "FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    made = subtable(
        t.lineitem, "l_returnflag", {"l_quantity": "sum", "l_extendedprice": "avg", "l_tax": "sum"}
    )
    return made.select(
        "l_returnflag",
        F.round("l_quantity_sum", 2).alias("l_quantity_sum"),
        F.round("l_extendedprice_avg", 4).alias("l_extendedprice_avg"),
        F.round("l_tax_sum", 2).alias("l_tax_sum"),
    )


@query(
    "subtable_min_max",
    "SELECT o_orderpriority, min(o_totalprice) AS o_totalprice_min, max(o_orderdate) AS o_orderdate_max, "
    "min(o_orderstatus) AS o_orderstatus_min, max(o_custkey) AS o_custkey_max "
    "FROM orders GROUP BY o_orderpriority",
)
def _(t):
    wanted = {"o_totalprice": "min", "o_orderdate": "max", "o_orderstatus": "min", "o_custkey": "max"}
    return subtable(t.orders, "o_orderpriority", wanted)


@query(
    "subtable_counts",
    "SELECT l_returnflag, count(nullif(l_discount, 0)) AS l_discount_count, "
    "count(DISTINCT l_partkey) AS l_partkey_count_distinct, "
    "count(DISTINCT l_shipdate) AS l_shipdate_count_distinct FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    gaps = t.lineitem.withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    wanted = {"l_discount": "count", "l_partkey": "count_distinct", "l_shipdate": "count_distinct"}
    return subtable(gaps, "l_returnflag", wanted)


@query("subtable_keys_only", "SELECT DISTINCT p_type FROM part")
def _(t):
    return subtable(t.part, "p_type", {"p_name": "none"})


@query(
    "subtable_filtered",
    "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum, "
    "count(o_orderkey) AS o_orderkey_count FROM orders "
    "WHERE o_orderstatus = 'O' GROUP BY o_orderpriority",
)
def _(t):
    made = subtable(
        t.orders,
        "o_orderpriority",
        {"o_totalprice": "sum", "o_orderkey": "count"},
        [flt.equal("o_orderstatus", "O")],
    )
    return made.withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2))


@query(
    "subtable_null_group",
    "SELECT nullif(l_linestatus, 'F') AS l_linestatus, count(l_orderkey) AS l_orderkey_count "
    "FROM lineitem GROUP BY 1",
)
def _(t):
    gaps = t.lineitem.withColumn("l_linestatus", F.nullif(F.col("l_linestatus"), F.lit("F")))
    return subtable(gaps, "l_linestatus", {"l_orderkey": "count"})


@query(
    "subtable_big_sum",
    "SELECT l_returnflag, CAST(sum(CAST(l_orderkey AS HUGEINT) * 1000000000000) AS DECIMAL(38, 0)) AS big_sum "
    "FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    big = t.lineitem.select("l_returnflag", (F.col("l_orderkey") * F.lit(10**12)).alias("big"))
    return subtable(big, "l_returnflag", {"big": "sum"})
