"""Order, limits, pages and row positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import filters as flt
from colonnade.operators import ordered, paging
from colonnade.operators.ranks import RankIndex
from colonnade.plans.registry import query

_BY_PRICE = [("o_totalprice", True), ("o_orderkey", True)]
_BY_PRICE_DESC = [("o_totalprice", False), ("o_orderkey", True)]
_WITH_GAPS = "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, o_totalprice FROM orders"


def _with_gaps(t):
    status = F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status")
    return t.orders.select("o_orderkey", status, "o_totalprice")


@query(
    "sort_asc",
    f"SELECT *, row_number() OVER (ORDER BY status ASC NULLS LAST, o_orderkey) AS row_number "
    f"FROM ({_WITH_GAPS})",
)
def _(t):
    return ordered.number_rows(_with_gaps(t), [("status", True), ("o_orderkey", True)])


@query(
    "sort_desc",
    f"SELECT *, row_number() OVER (ORDER BY status DESC NULLS LAST, o_orderkey) AS row_number "
    f"FROM ({_WITH_GAPS})",
)
def _(t):
    return ordered.number_rows(_with_gaps(t), [("status", False), ("o_orderkey", True)])


@query("sort_by_filter", "SELECT * FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    spec = [flt.equal("o_orderstatus", "P"), flt.sort_by("o_totalprice"), flt.sort_by("o_orderdate")]
    return paging.sort(flt.apply(t.orders, spec), flt.ordering(spec))


@query(
    "sort_last_wins",
    "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS place "
    "FROM orders WHERE o_orderstatus = 'P'",
)
def _(t):
    """Of several sorts in the filters the last one orders the rows, shown by their places."""
    spec = [flt.equal("o_orderstatus", "P"), flt.sort_by("o_totalprice"), flt.sort_by("o_orderdate", False)]
    order = [*flt.ordering(spec), ("o_orderkey", True)]
    return ordered.number_rows(flt.apply(t.orders, spec), order, "place").select("o_orderkey", "o_orderdate", "place")


@query(
    "top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def _(t):
    return paging.top(t.orders.select("o_orderkey", "o_totalprice"), _BY_PRICE_DESC, 100)


@query(
    "page_rows",
    "SELECT * FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 1000 OFFSET 3000",
)
def _(t):
    return paging.page(t.orders, _BY_PRICE, 3, 1000)


@query(
    "page_row_numbers",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number "
    "FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500 OFFSET 1000",
)
def _(t):
    made = paging.numbered_page(t.orders, _BY_PRICE, 2, 500)
    return made.select("o_orderkey", "row_number")


@query(
    "page_rows_deep",
    "SELECT o_orderkey, o_totalprice FROM orders "
    "ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 5000 OFFSET 5000",
)
def _(t):
    narrow = t.orders.select("o_orderkey", "o_totalprice")
    return paging.page(narrow, _BY_PRICE, 1, 5000)


@query(
    "page_rows_file_order",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT row_number() OVER () AS n, * FROM lineitem) "
    "WHERE l_returnflag = 'R' ORDER BY n LIMIT 1000 OFFSET 1000",
)
def _(t):
    view = flt.apply(t.lineitem, [flt.equal("l_returnflag", "R")])
    return paging.file_page(view, 1, 1000).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "page_count",
    "SELECT count(*) AS row_count, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS page_count "
    "FROM orders WHERE o_totalprice > 100000",
)
def _(t):
    return paging.page_count(flt.apply(t.orders, [flt.above("o_totalprice", 100000)]), 1000)


@query(
    "cell_value",
    "SELECT o_orderpriority FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 1 OFFSET 42",
)
def _(t):
    return paging.cell(t.orders, _BY_PRICE, 42, "o_orderpriority")


@query(
    "row_numbers",
    "SELECT o_orderkey, o_totalprice, "
    "row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number FROM orders",
)
def _(t):
    return ordered.number_rows(t.orders.select("o_orderkey", "o_totalprice"), _BY_PRICE)


@query(
    "row_numbers_file_order",
    "SELECT l_orderkey, l_linenumber, row_number() OVER () AS row_number FROM lineitem",
)
def _(t):
    return ordered.file_row_numbers(t.lineitem).select("l_orderkey", "l_linenumber", "row_number")


@query("row_count", "SELECT count(*) AS row_count FROM lineitem")
def _(t):
    return flt.filtered_count(t.lineitem, [])


@query("pages_joined", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    """All pages of a table in an order with many equal rows: every row once."""
    view = flt.apply(t.lineitem, [flt.equal("l_returnflag", "R")])
    view = view.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    size = -(-view.count() // 4)
    order = [("l_quantity", True)]
    ranks = RankIndex(view, order)
    pages = [paging.page(view, order, index, size, ranks) for index in range(4)]
    return pages[0].unionAll(pages[1]).unionAll(pages[2]).unionAll(pages[3])
