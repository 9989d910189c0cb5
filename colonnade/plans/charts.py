"""Chart series and layout numbers, on orders by status and priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import chart
from colonnade.operators import filters as flt
from colonnade.plans.registry import query

_ONE = "SELECT o_orderpriority AS category, sum(o_totalprice) AS value FROM orders GROUP BY 1"
_TWO = (
    "SELECT o_orderstatus AS series, o_orderpriority AS category, sum(o_totalprice) AS value "
    "FROM orders GROUP BY 1, 2"
)
_W = "PARTITION BY series ORDER BY category"


def _one(t, **options):
    return chart.series(t.orders, "o_orderpriority", "o_totalprice", **options)


def _two(t, **options):
    return chart.group_series(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice", **options)


def _rounded(df, **digits):
    digits = {"value": 2, **digits}
    return df.withColumns({name: F.round(name, n) for name, n in digits.items() if name in df.columns})


@query("chart_series", f"SELECT category, round(value, 2) AS value FROM ({_ONE})")
def _(t):
    return _rounded(_one(t))


@query(
    "chart_series_pct",
    "SELECT o_orderpriority AS category, round(sum(o_totalprice) * 100.0 / "
    "(SELECT sum(o_totalprice) FROM orders), 6) AS value FROM orders "
    "WHERE o_orderstatus = 'P' GROUP BY 1",
)
def _(t):
    shares = _one(t, filters=[flt.equal("o_orderstatus", "P")], percentage=True)
    return _rounded(shares, value=6)


@query(
    "chart_series_pct_filtered",
    "SELECT o_orderpriority AS category, round(sum(o_totalprice) * 100.0 / "
    "(SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus = 'P'), 6) AS value FROM orders "
    "WHERE o_orderstatus = 'P' GROUP BY 1",
)
def _(t):
    only = [flt.equal("o_orderstatus", "P")]
    return _rounded(_one(t, filters=only, percentage=True, denominator="filtered"), value=6)


@query("chart_group_series", f"SELECT series, category, round(value, 2) AS value FROM ({_TWO})")
def _(t):
    return _rounded(chart.ordered(_two(t)))


@query(
    "chart_group_series_pct",
    f"SELECT series, category, round(value * 100.0 / (SELECT sum(o_totalprice) FROM orders), 6) AS value FROM ({_TWO})",
)
def _(t):
    return _rounded(_two(t, percentage=True), value=6)


@query(
    "chart_filtered",
    "SELECT o_orderstatus AS series, o_orderpriority AS category, round(sum(o_totalprice), 2) AS value "
    "FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000 GROUP BY 1, 2",
)
def _(t):
    return _rounded(_two(t, filters=[flt.between("o_totalprice", 100000, 200000)]))


_SPARSE = (
    "SELECT o_orderstatus AS series, o_orderpriority AS category, sum(o_totalprice) AS value "
    "FROM orders WHERE o_totalprice > 499800 GROUP BY 1, 2"
)


@query(
    "chart_dense",
    f"WITH g AS ({_SPARSE}), f AS (SELECT category, min(series) AS first_series FROM g GROUP BY category) "
    "SELECT s.series, f.category, round(coalesce(g.value, 0), 2) AS value, f.first_series "
    "FROM (SELECT DISTINCT series FROM g) s CROSS JOIN f "
    "LEFT JOIN g ON g.series = s.series AND g.category = f.category",
)
def _(t):
    return _rounded(chart.dense(_two(t, filters=[flt.above("o_totalprice", 499800)])))


@query(
    "chart_pie_angles",
    f"SELECT series, category, round(value, 2) AS value, "
    f"round((sum(value) OVER ({_W}) - value) / sum(value) OVER (PARTITION BY series) * 360, 6) AS start_angle, "
    f"round(sum(value) OVER ({_W}) / sum(value) OVER (PARTITION BY series) * 360, 6) AS end_angle FROM ({_TWO})",
)
def _(t):
    return _rounded(chart.pie_angles(_two(t)), start_angle=6, end_angle=6)


@query(
    "chart_pie_angles_one",
    "SELECT category, round(value, 2) AS value, "
    "round((sum(value) OVER (ORDER BY category) - value) / sum(value) OVER () * 360, 6) AS start_angle, "
    f"round(sum(value) OVER (ORDER BY category) / sum(value) OVER () * 360, 6) AS end_angle FROM ({_ONE})",
)
def _(t):
    return _rounded(chart.pie_angles(_one(t)), start_angle=6, end_angle=6)


@query(
    "chart_bar_stack",
    f"SELECT series, category, round(value, 2) AS value, "
    f"round(value / sum(value) OVER (PARTITION BY series), 6) AS share, "
    f'round((sum(value) OVER ({_W}) - value) / sum(value) OVER (PARTITION BY series), 6) AS "offset" FROM ({_TWO})',
)
def _(t):
    return _rounded(chart.bar_stack(_two(t)), share=6, offset=6)


_SCALED = (
    "SELECT series, category, round(value, 2) AS value, "
    f"round(value / max(value) OVER (PARTITION BY series), 6) AS height FROM ({_TWO})"
)


@query("chart_scaled", _SCALED)
def _(t):
    return _rounded(chart.scaled(_two(t)), height=6)


@query("chart_scaled_points", _SCALED)
def _(t):
    return _rounded(chart.scaled(_two(t), marks="points"), height=6)


_BALANCES = (
    "SELECT c_mktsegment AS series, c_nationkey AS category, sum(c_acctbal) AS value FROM customer "
    "WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING' GROUP BY 1, 2"
)


@query(
    "chart_scaled_points_negative",
    "SELECT series, category, round(value, 2) AS value, round(value / CASE WHEN max(value) OVER s > 0 THEN max(value) OVER s ELSE 1 END, 2) AS height "
    f"FROM ({_BALANCES}) WINDOW s AS (PARTITION BY series)",
)
def _(t):
    """Series without a positive value keep their heights."""
    seen = t.customer.where("c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
    return _rounded(chart.scaled(chart.group_series(seen, "c_mktsegment", "c_nationkey", "c_acctbal"), marks="points"), height=2)


@query(
    "chart_area_scaled",
    f"SELECT series, category, round(value, 2) AS value, round(value / max(value) OVER (), 6) AS height FROM ({_TWO})",
)
def _(t):
    return _rounded(chart.area_scaled(_two(t)), height=6)


@query(
    "chart_radar",
    "WITH p AS (SELECT series, category, value, value / max(value) OVER (PARTITION BY series) AS radius, "
    f"(row_number() OVER ({_W}) - 1) * 360.0 / count(*) OVER (PARTITION BY series) - 90 AS angle FROM ({_TWO})) "
    "SELECT series, category, round(value, 2) AS value, round(radius, 6) AS radius, "
    "round(CAST(angle AS DOUBLE), 6) AS angle, round(radius * cos(radians(angle)), 4) + 0.0 AS x, "
    "round(radius * sin(radians(angle)), 4) + 0.0 AS y FROM p",
)
def _(t):
    made = _rounded(chart.radar(_two(t)), radius=6, angle=6, x=4, y=4)
    return made.withColumns({name: F.col(name) + F.lit(0.0) for name in ("x", "y")})


def _ticks(scale, formula):
    top = f"(SELECT max(value) AS top FROM ({_TWO}))"
    tick = "top / 8.0 * i"
    sql = (
        f"SELECT CAST(i AS INTEGER) AS step, round({tick}, 2) AS tick, "
        f"round({formula.format(tick)} / {formula.format('top')}, 6) AS position "
        f"FROM {top}, range(9) r(i)"
    )
    query(f"chart_axis_ticks_{scale.lower()}", sql)(
        lambda t: _rounded(chart.axis_ticks(_two(t), 8, scale), tick=2, position=6)
    )


query(
    "chart_axis_ticks",
    "SELECT CAST(i AS INTEGER) AS step, round(top / 5.0 * i, 2) AS tick, round(i / 5.0, 6) AS position "
    f"FROM (SELECT max(value) AS top FROM ({_TWO})), range(6) r(i)",
)(lambda t: _rounded(chart.axis_ticks(_two(t)), tick=2, position=6))

_ticks("LOG", "CASE WHEN {0} > 0 THEN log10({0}) ELSE 0 END")
_ticks("SQRT", "sqrt({0})")


@query(
    "chart_series_stats",
    "SELECT series, round(sum(value), 2) AS sum, round(max(value), 2) AS max, round(min(value), 2) AS min, "
    f"round(avg(value), 2) AS average, count(*) AS size FROM ({_TWO}) GROUP BY series",
)
def _(t):
    return _rounded(chart.series_statistics(_two(t)), sum=2, max=2, min=2, average=2)


@query(
    "chart_group_stats",
    "SELECT round(sum(s), 2) AS sum, round(max(hi), 2) AS max, round(min(lo), 2) AS min, "
    "count(*) AS size, max(n) AS max_size FROM (SELECT sum(value) AS s, max(value) AS hi, "
    f"min(value) AS lo, count(*) AS n FROM ({_TWO}) GROUP BY series)",
)
def _(t):
    return _rounded(chart.group_statistics(_two(t)), sum=2, max=2, min=2)


def flagship(t):
    """Price by return flag as a share of all prices, of medium quantities."""
    return chart.series(
        t.lineitem,
        "l_returnflag",
        "l_extendedprice",
        [flt.between("l_quantity", 10, 40)],
        percentage=True,
    )


query(
    "flagship",
    "SELECT l_returnflag AS category, round(sum(l_extendedprice) * 100.0 / "
    "(SELECT sum(l_extendedprice) FROM lineitem), 6) AS value FROM lineitem "
    "WHERE l_quantity BETWEEN 10 AND 40 GROUP BY 1",
)(lambda t: _rounded(flagship(t), value=6))
