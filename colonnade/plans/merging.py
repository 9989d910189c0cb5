"""Joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import merge
from colonnade.plans.registry import query

_ORDER = "o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority"
_LINE = (
    "l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount, "
    "l.l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate"
)
_ON_ORDER = [("o_orderkey", "l_orderkey")]


@query(
    "merge_inner",
    f"SELECT {_ORDER}, {_LINE} FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey",
)
def _(t):
    return merge.join(t.orders, t.lineitem, "inner", _ON_ORDER)


@query(
    "merge_left",
    f"SELECT {_ORDER}, {_LINE} FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey",
)
def _(t):
    return merge.join(t.orders, t.lineitem, "left", _ON_ORDER)


@query(
    "merge_right",
    "SELECT l.doc_id, l.quality, l.toxic, d.text, d.lang, d.source, d.n_chars "
    "FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id",
)
def _(t):
    return merge.join(t.labels, t.documents, "right", [("doc_id", "doc_id")])


# German documents have no key here, and most documents have no label.
_PARTIAL = (
    "(SELECT nullif(quality, 0) AS q, doc_id AS k, toxic FROM labels) a FULL JOIN "
    "(SELECT CASE WHEN lang <> 'de' THEN doc_id END AS k, lang, source FROM documents) b ON a.k = b.k"
)


def _partial(t):
    left = t.labels.select(F.nullif(F.col("quality"), F.lit(0)).alias("q"), F.col("doc_id").alias("k"), "toxic")
    right = t.documents.select(F.expr("CASE WHEN lang <> 'de' THEN doc_id END").alias("k"), "lang", "source")
    return left, right


@query("merge_full", f"SELECT a.q, a.k, a.toxic, b.lang, b.source FROM {_PARTIAL}")
def _(t):
    return merge.join(*_partial(t), "full", [("k", "k")])


_SEGMENTS = "SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey ELSE n_nationkey + 100 END AS k, n_name FROM nation"


def _segments(t):
    moved = F.when(F.col("n_nationkey") < 20, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + 100)
    return t.nation.select(moved.alias("k"), "n_name")


def _hot(how):
    # Every nation holds a large share of the customers, so all keys count as hot.
    sql = (
        f"SELECT n.k, n.n_name, c.c_custkey, c.c_name, c.c_acctbal, c.c_mktsegment "
        f"FROM ({_SEGMENTS}) n {how.upper()} JOIN customer c ON n.k = c.c_nationkey"
    )
    query(f"merge_{how}_hot_keys", sql)(
        lambda t: merge.join(_segments(t), t.customer, how, [("k", "c_nationkey")], hot_rows=1)
    )


for _how in ("left", "right", "full"):
    _hot(_how)


@query(
    "merge_multi_key",
    "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_suppkey, b.l_tax "
    "FROM lineitem a JOIN lineitem b "
    "ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
)
def _(t):
    left = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    right = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_tax")
    return merge.join(
        left, right, "inner", [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")]
    )


@query(
    "merge_collision",
    "SELECT c.c_custkey AS id, c.c_name AS name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, "
    "s.s_suppkey AS right_table_id, s.s_name AS right_table_name, s.s_acctbal "
    "FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey",
)
def _(t):
    left = t.customer.withColumnsRenamed({"c_custkey": "id", "c_name": "name"})
    right = t.supplier.withColumnsRenamed({"s_suppkey": "id", "s_name": "name"})
    return merge.join(left, right, "inner", [("c_nationkey", "s_nationkey")])


@query(
    "merge_auto_keys",
    "SELECT o.o_orderkey, o.o_custkey AS CustKey, o.o_totalprice, c.c_name, c.c_mktsegment "
    "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
)
def _(t):
    left = t.orders.select("o_orderkey", F.col("o_custkey").alias("CustKey"), "o_totalprice")
    right = t.customer.select("c_name", F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return merge.join(left, right, "inner", merge.auto_keys(left.columns, right.columns))


@query(
    "union_all",
    "SELECT c_custkey, c_name, c_acctbal FROM customer "
    "UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier",
)
def _(t):
    return merge.union(
        t.customer.select("c_custkey", "c_name", "c_acctbal"),
        t.supplier.select("s_suppkey", "s_name", "s_acctbal"),
    )


@query(
    "union_mixed_types",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_nationkey FROM customer "
    "UNION ALL SELECT s_name, CAST(s_suppkey AS VARCHAR), s_nationkey FROM supplier",
)
def _(t):
    return merge.union(
        t.customer.select("c_custkey", "c_name", "c_nationkey"),
        t.supplier.select("s_name", "s_suppkey", "s_nationkey"),
    )
