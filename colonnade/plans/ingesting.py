"""Type vote, casts from text, retyping and cell edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions import casts
from colonnade.operators import edit
from colonnade.operators import filters as flt
from colonnade.plans.registry import query
from colonnade.sources import ingest
from colonnade.types import LogicalType

# Orders as a text table: two percent of the cells of three columns are unreadable.
_TEXT = """
  SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'N/A' ELSE CAST(o_orderkey AS VARCHAR) END AS code,
         CASE WHEN o_custkey % 50 = 0 THEN 'N/A'
              ELSE replace(CAST(o_totalprice AS VARCHAR), '.', ',') END AS price,
         CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END AS flag,
         CASE WHEN o_orderkey % 50 = 7 THEN '31/02/2021'
              ELSE strftime(o_orderdate, '%d/%m/%Y') END AS day,
         o_orderpriority AS label,
         CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS VARCHAR) END AS sparse,
         CAST(NULL AS VARCHAR) AS blank
  FROM orders
"""


def _text_table(t):
    bad = lambda key, rest, text: F.when(F.col(key) % 50 == rest, text)
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy")
    return t.orders.select(
        bad("o_orderkey", 0, "N/A").otherwise(F.col("o_orderkey").cast("string")).alias("code"),
        bad("o_custkey", 0, "N/A")
        .otherwise(F.translate(F.col("o_totalprice").cast("string"), ".", ","))
        .alias("price"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no").alias("flag"),
        bad("o_orderkey", 7, "31/02/2021").otherwise(day).alias("day"),
        F.col("o_orderpriority").alias("label"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey").cast("string")).alias("sparse"),
        F.lit(None).cast("string").alias("blank"),
    )


_INT = "CASE WHEN regexp_full_match({0}, '\\s*[+-]?\\d+\\s*') THEN TRY_CAST({0} AS INTEGER) END"
_DOUBLE = "TRY_CAST(replace({0}, ',', '.') AS DOUBLE)"
_BOOL = "TRY_CAST({0} AS BOOLEAN)"
_DATE = (
    "COALESCE(TRY_STRPTIME({0}, '%d/%m/%Y'), TRY_STRPTIME({0}, '%Y-%m-%d'), TRY_STRPTIME({0}, '%m/%d/%Y'))"
)
_COLUMNS = ["code", "price", "flag", "day", "label", "sparse", "blank"]


def _vote_sql():
    counts = " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", count({c}) AS non_null, "
        f"count({_BOOL.format(c)}) AS boolean, count({_INT.format(c)}) AS integer, "
        f"count({_DOUBLE.format(c)}) AS double, count({_DATE.format(c)}) AS date FROM ({_TEXT})"
        for i, c in enumerate(_COLUMNS)
    )
    return (
        "SELECT *, CASE WHEN non_null = 0 THEN 'STRING' WHEN boolean >= non_null * 0.95 THEN 'BOOLEAN' "
        "WHEN integer >= non_null * 0.95 THEN 'INTEGER' WHEN double >= non_null * 0.95 THEN 'DOUBLE' "
        f"WHEN date >= non_null * 0.95 THEN 'DATE' ELSE 'STRING' END AS logical_type FROM ({counts})"
    )


@query("ingest_vote", _vote_sql())
def _(t):
    return ingest.vote(_text_table(t))


@query(
    "ingest_cast",
    f"SELECT {_INT.format('code')} AS code, {_DOUBLE.format('price')} AS price, "
    f"{_BOOL.format('flag')} AS flag, {_DATE.format('day')} AS day, label, "
    f"{_INT.format('sparse')} AS sparse, blank FROM ({_TEXT})",
)
def _(t):
    return ingest.typed(_text_table(t))


@query(
    "cast_decimal_comma",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 <> 0 THEN l_extendedprice END AS price "
    "FROM lineitem",
)
def _(t):
    text = F.translate(F.col("l_extendedprice").cast("string"), ".", ",")
    dirty = F.when(F.col("l_orderkey") % 50 == 0, "N/A").otherwise(text)
    return t.lineitem.select("l_orderkey", "l_linenumber", casts.to_double(dirty).alias("price"))


_THREE_LAYOUTS = (
    "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') "
    "WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') "
    "ELSE 'N/A' END"
)


@query(
    "parse_dates",
    f"SELECT o_orderkey, {_DATE.format('d')} AS day FROM (SELECT o_orderkey, {_THREE_LAYOUTS} AS d FROM orders)",
)
def _(t):
    moment = F.col("o_orderdate").cast("timestamp")
    text = F.lit("N/A")
    for rest, layout in ((0, "dd/MM/yyyy"), (1, "yyyy-MM-dd"), (2, "MM/dd/yyyy")):
        text = F.when(F.col("o_orderkey") % 4 == rest, F.date_format(moment, layout)).otherwise(text)
    return t.orders.select("o_orderkey", casts.to_timestamp(text).alias("day"))


@query(
    "retype_column",
    "SELECT p_partkey, TRY_CAST(p_brand AS INTEGER) AS p_brand, p_type, "
    "CAST(p_size AS VARCHAR) AS p_size, TRY_CAST(p_retailprice AS INTEGER) AS p_retailprice FROM part",
)
def _(t):
    made = edit.hide(t.part, "p_name")
    made = edit.retype(made, "p_retailprice", LogicalType.INTEGER)
    made = edit.retype(made, "p_size", LogicalType.STRING)
    return edit.retype(made, "p_brand", LogicalType.INTEGER)


@query(
    "cell_update",
    "SELECT p_partkey, CASE WHEN p_partkey = (SELECT p_partkey FROM part WHERE p_size > 10 "
    "ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 1 OFFSET 5) THEN 'edited' ELSE p_name END AS p_name, "
    "p_brand, p_type, p_size, p_retailprice FROM part",
)
def _(t):
    return edit.update_cell(
        t.part,
        5,
        "p_name",
        "edited",
        order=[("p_retailprice", False)],
        filters=[flt.above("p_size", 10)],
        key=["p_partkey"],
    )


@query(
    "cell_update_by_place",
    "SELECT l_orderkey, l_linenumber, CASE WHEN n = (SELECT n FROM (SELECT row_number() OVER () AS n, * "
    "FROM lineitem) WHERE l_returnflag = 'R' ORDER BY n LIMIT 1 OFFSET 7) THEN 12.5 ELSE l_quantity END AS l_quantity "
    "FROM (SELECT row_number() OVER () AS n, * FROM lineitem)",
)
def _(t):
    made = edit.update_cell(
        t.lineitem, 7, "l_quantity", "12,5", filters=[flt.equal("l_returnflag", "R")]
    )
    return made.select("l_orderkey", "l_linenumber", "l_quantity")
