import datetime
import operator
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from colonnade.operators import filters as flt
from colonnade.operators.filters import Condition, Filter, Func, Logic, Op
from colonnade.types import LogicalType
from tests.conftest import values


def ids(df, *specs, **options):
    return sorted(values(flt.apply(df, specs, **options), "id"))


def test_comparisons_and_null_tests(main):
    assert ids(main, flt.equal("val", 20)) == [2]
    assert ids(main, flt.where("val", "NOT_EQUAL", "20.0")) == [1, 4, 5]
    assert ids(main, flt.above("val", 10)) == [1, 2, 5]
    assert ids(main, flt.below("val", 10.5)) == [4]
    assert ids(main, flt.show_empty("val")) == [3]
    assert ids(main, flt.hide_empty("val")) == [1, 2, 4, 5]
    assert ids(main, flt.equal("flag", "true")) == [1, 4]
    assert ids(main, flt.equal("txt", "O'Brien")) == [3]


def test_range_takes_bounds_in_either_order(main):
    assert ids(main, flt.between("val", 20, 10)) == [1, 2]
    assert ids(main, flt.between("val", "9", "10.5")) == [1]
    assert ids(main, flt.between("d", "2024-01-04", "2024-01-02")) == [2, 3, 4]


def test_date_column_drops_time_of_literal(main):
    assert ids(main, flt.where("d", "GREATER_EQUAL", "2024-01-04 10:00:00")) == [4, 5]
    assert ids(main, flt.equal("d", datetime.datetime(2024, 1, 4))) == [4]


def test_search_wildcards_and_backslash(spark):
    rows = [(1, "a%b"), (2, "a_b"), (3, "axb"), (4, "a\\b"), (5, None), (6, "AXB")]
    df = spark.createDataFrame(rows, "id int, t string")
    assert ids(df, flt.search("t", "a_b")) == [1, 2, 3, 4]
    assert ids(df, flt.search("t", "xb")) == [3]
    assert ids(df, flt.search("t", "\\")) == [4]
    assert ids(df, flt.search("t", "%")) == [1, 2, 3, 4, 6]


def test_length_filters(main):
    assert ids(main, flt.length_between("txt", 5, 6)) == [1, 4, 5]
    assert ids(main, flt.longer_than("txt", 5)) == [3]
    assert ids(main, flt.shorter_than("txt", 5)) == [2]


@pytest.mark.parametrize("op", [o for o in Op if o not in (Op.LIKE, Op.IS_NULL, Op.NOT_NULL)])
@pytest.mark.parametrize("text", ["2", "1.5", "-1.5", "2.0", "1e3", "9e30", "-9e30", "inf", "-inf"])
def test_integer_bounds_compare_as_numbers(spark, op, text):
    compare = {
        Op.EQUAL: operator.eq, Op.NOT_EQUAL: operator.ne, Op.GREATER: operator.gt,
        Op.GREATER_EQUAL: operator.ge, Op.LESS: operator.lt, Op.LESS_EQUAL: operator.le,
    }[op]
    df = spark.range(-3, 4).select(F.col("id").cast("int").alias("id"))
    expected = [i for i in range(-3, 4) if compare(i, float(text))]
    assert ids(df, flt.where("id", op, text)) == expected


@pytest.mark.parametrize(
    ("column", "value"), [("id", "abc"), ("val", "x"), ("flag", "maybe"), ("d", "04/01/2024")]
)
def test_malformed_literals_are_refused(main, column, value):
    with pytest.raises(ValueError):
        flt.predicate([flt.equal(column, value)], main)


def test_misplaced_operators_are_refused(main):
    for bad in (
        flt.search("id", "1"),
        flt.above("txt", 3),
        flt.longer_than("id", 3),
        flt.where("txt", "LIKE", "a", "LENGTH"),
        flt.where("id", "EQUAL"),
        flt.equal("nope", 1),
    ):
        with pytest.raises(ValueError):
            flt.predicate([bad], main)


def test_precedence_and_preceding_connective(spark):
    rows = [(i, bool(i & 4), bool(i & 2), bool(i & 1)) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, a boolean, b boolean, c boolean")
    a, b, c = (flt.equal(name, "true") for name in "abc")
    got = ids(df, a.joined_by("OR"), flt.sort_by("id"), b, c)
    assert got == [i for i, a_, b_, c_ in rows if a_ or b_ and c_]
    got = ids(df, a, b.joined_by("OR"), c)
    assert got == [i for i, a_, b_, c_ in rows if a_ and b_ or c_]


def test_grouping_puts_a_filter_in_parentheses(products):
    ends = Filter("price", (Condition(Op.LESS, "120"), Condition(Op.GREATER, "180")), Logic.OR)
    tail = Filter("id", (Condition(Op.GREATER, "1"), Condition(Op.LESS, "4")))
    # flat: price < 120 OR price > 180 OR id > 1 AND id < 4
    assert ids(products, ends, tail) == [1, 2, 3, 4]
    first = Filter("id", (Condition(Op.GREATER, "1"),))
    # flat: id > 1 AND price < 120 OR price > 180; grouped: id > 1 AND (price < 120 OR price > 180)
    assert ids(products, first, Filter("price", ends.conditions, Logic.OR)) == [2, 4]
    assert ids(products, first, Filter("price", ends.conditions, Logic.OR), grouped=True) == [2, 4]
    low = Filter("id", (Condition(Op.GREATER, "2"),))
    cheap = Filter("price", (Condition(Op.LESS, "160"), Condition(Op.EQUAL, "200")), Logic.OR)
    assert ids(products, low, cheap) == [2, 3]
    assert ids(products, low, cheap, grouped=True) == [3]


def test_sort_only_filters_restrict_nothing(products):
    assert flt.predicate([flt.sort_by("price")], products) is None
    specs = [flt.sort_by("price"), flt.search("product", "a"), flt.sort_by("product", False)]
    assert ids(products, *specs) == [1, 2, 4]
    assert flt.ordering(specs) == [("product", False)]


def test_json_round_trip_and_clear():
    specs = [
        flt.length_between("txt", 2, 5).joined_by("OR"),
        flt.sort_by("id", False),
        flt.show_empty("val"),
    ]
    assert flt.from_json(flt.to_json(specs)) == specs
    assert flt.clear_column(specs, "id") == [specs[0], specs[2]]
    assert specs[0].conditions[0].func is Func.LENGTH


def test_decimal_literal(spark):
    df = spark.createDataFrame([(1, Decimal("1.10")), (2, Decimal("2.20"))], "id int, x decimal(5,2)")
    assert ids(df, flt.equal("x", "1.1")) == [1]


def test_offered_operators():
    offered = flt.allowed_operators
    assert offered(LogicalType.EMPTY) == (Op.IS_NULL, Op.NOT_NULL)
    assert Op.LIKE in offered(LogicalType.STRING)
    assert Op.LIKE not in offered(LogicalType.STRING, has_categories=True)
    assert Op.GREATER not in offered(LogicalType.BOOLEAN)
    assert Op.LESS_EQUAL in offered(LogicalType.DATE)
    flt.check_allowed(flt.longer_than("t", 3), LogicalType.STRING)
    with pytest.raises(ValueError):
        flt.check_allowed(flt.search("n", "1"), LogicalType.INTEGER)


def test_text_with_categories_is_picked_not_searched(spark):
    from colonnade.table import Table

    df = spark.createDataFrame([("F", "one"), ("O", "two"), ("F", "three")], "status string, note string")
    table = Table(df, "t")
    for item in (flt.search("status", "F"), flt.where("status", "NOT_EQUAL", "F")):
        with pytest.raises(ValueError, match="not offered"):
            table.add_filters(item)
        assert table.add_filters(item, free_text=True).filters == (item,)
    assert table.add_filters(flt.search("note", "o")).view().count() == 2
    assert table.add_filters(flt.equal("status", "F")).view().count() == 2
    assert table.add_filters(flt.longer_than("status", 0)).view().count() == 3
