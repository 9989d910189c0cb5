"""Predicates, their composition, and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import edit
from colonnade.operators import filters as flt
from colonnade.operators.filters import Condition, Filter, Logic, Op
from colonnade.plans.registry import query

_LINE = "l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_extendedprice"


def _line(t, *filters, grouped=False):
    return flt.apply(t.lineitem, filters, grouped).select(*_LINE.split(", "))


def _with_gaps(t):
    """Lineitem whose zero discounts and whose status ``F`` are missing."""
    return t.lineitem.withColumns(
        {
            "l_discount": F.nullif(F.col("l_discount"), F.lit(0.0)),
            "l_linestatus": F.nullif(F.col("l_linestatus"), F.lit("F")),
        }
    )


def _compare(name, op, column, value, literal, sign):
    sql = f"SELECT {_LINE} FROM lineitem WHERE {column} {sign} {literal}"
    query(name, sql)(lambda t: _line(t, flt.where(column, op, value)))


_compare("filter_equal", Op.EQUAL, "l_quantity", 17, "17", "=")
_compare("filter_not_equal", Op.NOT_EQUAL, "l_returnflag", "R", "'R'", "<>")
_compare("filter_greater", Op.GREATER, "l_quantity", "45", "45", ">")
_compare("filter_greater_equal", Op.GREATER_EQUAL, "l_discount", "0.07", "0.07", ">=")
_compare("filter_less", Op.LESS, "l_quantity", "5", "5", "<")
_compare("filter_less_equal", Op.LESS_EQUAL, "l_discount", 0.03, "0.03", "<=")
# A whole-number column against a fraction compares as numbers.
_compare("filter_integer_bound", Op.GREATER_EQUAL, "l_linenumber", "4.5", "4.5", ">=")


@query("filter_above", f"SELECT {_LINE} FROM lineitem WHERE l_extendedprice > 90000.5")
def _(t):
    return _line(t, flt.above("l_extendedprice", 90000.5))


@query("filter_below", f"SELECT {_LINE} FROM lineitem WHERE l_extendedprice < 1500")
def _(t):
    return _line(t, flt.below("l_extendedprice", 1500))


@query("filter_range", f"SELECT {_LINE} FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def _(t):
    return _line(t, flt.between("l_quantity", 20, 10))


@query("filter_search", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%'")
def _(t):
    return flt.apply(t.part, [flt.search("p_name", "red")]).select("p_partkey", "p_name")


@query("filter_search_wildcard", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%b_l%'")
def _(t):
    return flt.apply(t.part, [flt.search("p_name", "b_l")]).select("p_partkey", "p_name")


@query(
    "filter_length_range",
    "SELECT p_partkey, p_name FROM part WHERE length(p_name) BETWEEN 8 AND 9",
)
def _(t):
    return flt.apply(t.part, [flt.length_between("p_name", 8, 9)]).select("p_partkey", "p_name")


@query("filter_length_above", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 2000")
def _(t):
    return flt.apply(t.documents, [flt.longer_than("text", 2000)]).select("doc_id", "n_chars")


@query(
    "filter_date_range",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate "
    "BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 12:00:00'",
)
def _(t):
    year = flt.between("o_orderdate", "1996-01-01 00:00:00", "1996-12-31 12:00:00")
    return flt.apply(t.orders, [year]).select("o_orderkey", "o_orderdate")


@query(
    "filter_date_equal",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = TIMESTAMP '1997-03-05 00:00:00'",
)
def _(t):
    day = flt.equal("o_orderdate", "1997-03-05 00:00:00")
    return flt.apply(t.orders, [day]).select("o_orderkey", "o_orderdate")


@query(
    "filter_category",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def _(t):
    return flt.apply(t.customer, [flt.equal("c_mktsegment", "BUILDING")]).select(
        "c_custkey", "c_mktsegment"
    )


@query(
    "filter_boolean",
    "SELECT doc_id, quality FROM labels WHERE (quality = 1) = true",
)
def _(t):
    flagged = t.labels.withColumn("good", F.col("quality") == 1)
    return flt.apply(flagged, [flt.equal("good", True)]).select("doc_id", "quality")


@query(
    "filter_is_null",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE nullif(l_discount, 0) IS NULL",
)
def _(t):
    return flt.apply(_with_gaps(t), [flt.show_empty("l_discount")]).select(
        "l_orderkey", "l_linenumber", "l_quantity"
    )


@query(
    "filter_not_null",
    "SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem "
    "WHERE nullif(l_linestatus, 'F') IS NOT NULL",
)
def _(t):
    return flt.apply(_with_gaps(t), [flt.hide_empty("l_linestatus")]).select(
        "l_orderkey", "l_linenumber", "l_linestatus"
    )


@query(
    "filter_or_conditions",
    f"SELECT {_LINE} FROM lineitem WHERE l_quantity < 3 OR l_quantity >= 49",
)
def _(t):
    ends = (Condition(Op.LESS, "3"), Condition(Op.GREATER_EQUAL, "49"))
    return _line(t, Filter("l_quantity", ends, Logic.OR))


def _three_filters():
    return [
        flt.equal("l_returnflag", "R").joined_by("OR"),
        flt.between("l_quantity", 10, 40),
        flt.sort_by("l_extendedprice"),
        flt.above("l_discount", 0.05),
    ]


@query(
    "filter_multi",
    f"SELECT {_LINE} FROM lineitem WHERE l_returnflag = 'R' "
    "OR l_quantity >= 10 AND l_quantity <= 40 AND l_discount > 0.05",
)
def _(t):
    return _line(t, *_three_filters())


@query(
    "filter_multi_grouped",
    f"SELECT {_LINE} FROM lineitem "
    "WHERE (l_quantity < 3 OR l_quantity > 48) OR (l_discount > 0.05 AND l_discount < 0.08)",
)
def _(t):
    ends = Filter("l_quantity", (Condition(Op.LESS, "3"), Condition(Op.GREATER, "48")), Logic.OR)
    middle = (Condition(Op.GREATER, "0.05"), Condition(Op.LESS, "0.08"))
    return _line(t, ends, Filter("l_discount", middle), grouped=True)


@query(
    "filtered_count",
    "SELECT count(*) AS row_count FROM lineitem WHERE l_returnflag = 'R' "
    "OR l_quantity >= 10 AND l_quantity <= 40 AND l_discount > 0.05",
)
def _(t):
    return flt.filtered_count(t.lineitem, _three_filters())


@query("select_columns", "SELECT p_name, p_partkey, p_retailprice FROM part")
def _(t):
    return edit.select(t.part, ["p_name", "p_partkey", "p_retailprice"])


@query(
    "rename_column",
    "SELECT p_partkey, p_name AS title, p_brand, p_type, p_size, p_retailprice FROM part",
)
def _(t):
    return edit.rename(t.part, "p_name", "title")


@query("hide_columns", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def _(t):
    return edit.hide(t.part, "p_type", "p_size")


@query(
    "null_display",
    "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, "
    "CAST(l_linenumber AS VARCHAR) AS l_linenumber, "
    "coalesce(CAST(nullif(l_discount, 0) AS VARCHAR), '(null)') AS l_discount, "
    "coalesce(nullif(l_linestatus, 'F'), '(null)') AS l_linestatus FROM lineitem",
)
def _(t):
    shown = edit.select(_with_gaps(t), ["l_orderkey", "l_linenumber", "l_discount", "l_linestatus"])
    return edit.null_display(shown)


@query(
    "filter_narrow_numbers",
    "SELECT 'above' AS test, count(*) FILTER (l_linenumber > 100000) AS row_count FROM lineitem UNION ALL "
    "SELECT 'below', count(*) FILTER (l_linenumber < 100000) FROM lineitem UNION ALL "
    "SELECT 'at_least', count(*) FILTER (l_linenumber >= -100000.5) FROM lineitem UNION ALL "
    "SELECT 'at_most', count(*) FILTER (l_linenumber <= -100000.5) FROM lineitem UNION ALL "
    "SELECT 'equal', count(*) FILTER (l_linenumber = 100000) FROM lineitem UNION ALL "
    "SELECT 'not_equal', count(*) FILTER (l_linenumber <> 100000) FROM lineitem UNION ALL "
    "SELECT 'edge', count(*) FILTER (l_linenumber < 32767.5) FROM lineitem",
)
def _(t):
    narrow = t.lineitem.select(F.col("l_linenumber").cast("smallint").alias("x"))
    tests = {
        "above": (Op.GREATER, "100000"),
        "below": (Op.LESS, "100000"),
        "at_least": (Op.GREATER_EQUAL, "-100000.5"),
        "at_most": (Op.LESS_EQUAL, "-100000.5"),
        "equal": (Op.EQUAL, "100000"),
        "not_equal": (Op.NOT_EQUAL, "100000"),
        "edge": (Op.LESS, "32767.5"),
    }
    counts = []
    for name, (op, value) in tests.items():
        kept = flt.predicate([Filter("x", (Condition(op, value),))], narrow)
        counts.append(F.count_if(kept).alias(name))
    return narrow.agg(*counts).unpivot([], list(tests), "test", "row_count")
