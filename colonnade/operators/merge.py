"""Equi-joins of two tables and positional union."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.types import LogicalType, classify, col, field_type

Pairs = Sequence[tuple[str, str]]

JOIN_TYPES = ("inner", "left", "right", "full")
COLLISION_PREFIX = "right_table_"
# An outer join gives a key its own plan once it holds this many rows of the side
# the join cannot split, and this share of that side.
HOT_ROWS = 2_000_000
HOT_SHARE = 5e-5
# The key sketch: buckets by key, items kept and items reported per bucket. A key is
# missed only below 1 / (0.75 * buckets * items) of the rows, about 4e-5.
_BUCKETS, _ITEMS, _TOP = 64, 512, 16
# An inner join deals a key that makes more rows than this to several tasks, each of
# which makes about so many, and starts so many tasks for them at most.
SPREAD_ROWS = 4_000_000
_SPREAD_TASKS = 20_000


def auto_keys(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs of equal names ignoring case: each left name with its first match."""
    first: dict[str, str] = {}
    for name in right:
        first.setdefault(name.lower(), name)
    return [(name, first[name.lower()]) for name in left if name.lower() in first]


def result_name(left_alias: str, right_alias: str) -> str:
    return f"{left_alias}_{right_alias}"


def output_columns(left: Sequence[str], right: Sequence[str], pairs: Pairs) -> list[tuple[str, str]]:
    """``(right column, output name)`` of the right columns a join keeps."""
    keys = {r for _, r in pairs}
    taken = {name.lower() for name in left}
    kept = []
    for name in right:
        if name in keys:
            continue
        out = name
        while out.lower() in taken:
            out = COLLISION_PREFIX + out
        taken.add(out.lower())
        kept.append((name, out))
    return kept


def _key_group(spark_type: T.DataType) -> str:
    kind = classify(spark_type)
    return "number" if kind.is_numeric else kind.value


def _comparable(left: T.DataType, right: T.DataType, names: tuple[str, str]) -> str | None:
    """Type both keys hash alike in, or ``None`` when their own type does."""
    if _key_group(left) != _key_group(right):
        raise ValueError(
            f"cannot join {names[0]!r} ({left.simpleString()}) with "
            f"{names[1]!r} ({right.simpleString()})"
        )
    if left == right and not isinstance(left, T.FractionalType):
        return None
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return "bigint"
    if classify(left).is_numeric:
        return "double"
    return "timestamp" if classify(left) is LogicalType.DATE else "string"


def _key_hash(columns: list[Column], types: list[str | None]) -> Column:
    """Hash of a row's key, null when any part is null (such a key matches nothing)."""
    parts = []
    for column, kind in zip(columns, types, strict=True):
        part = column if kind is None else column.cast(kind)
        # 0.0 + -0.0 is 0.0, so both zeros hash alike.
        parts.append(part + F.lit(0.0) if kind == "double" else part)
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return F.when(present, F.xxhash64(*parts))


def hot_keys(hashes: DataFrame, hot_rows: int, hot_share: float = HOT_SHARE) -> set[int]:
    """Key hashes that hold many rows, from small frequent-items sketches.

    ``hashes`` has one column ``k``. Tasks send bounded sketches, not keys, and the
    buckets share out their merging. The answer only steers the plan: the join is
    exact whatever is reported.
    """
    total, found = _sketched(hashes)
    limit = max(hot_rows, hot_share * total)
    return {key for key, count in found.items() if count >= limit}


def _sketched(hashes: DataFrame) -> tuple[int, dict[int, int]]:
    """The number of keys present, and the frequent ones with about how often they occur."""
    bucket = F.pmod("k", F.lit(_BUCKETS)).alias("bucket")
    sketches = hashes.where("k is not null").groupBy(bucket).agg(
        F.count("k").alias("n"), F.expr(f"approx_top_k(k, {_TOP}, {_ITEMS})").alias("top")
    ).collect()
    return sum(row["n"] for row in sketches), {item["item"]: item["count"] for row in sketches for item in row["top"]}


def _multiplied(left: DataFrame, right: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows on both sides of the key hashes that make more than ``SPREAD_ROWS`` rows together.

    Sketches name the keys, which are then counted exactly.
    """
    total, often = _sketched(right)
    if not often:
        return {}
    rows, many = _sketched(left)
    # A key that a sketch does not name has at most this share of the rows.
    share = 1 / (0.75 * _BUCKETS * _ITEMS)
    named = [k for k in often.keys() | many.keys() if many.get(k, rows * share) * often.get(k, total * share) > SPREAD_ROWS]
    if not named:
        return {}
    a, b = (
        {r["k"]: r["n"] for r in side.where(F.col("k").isin(*named)).groupBy("k").agg(F.count("k").alias("n")).collect()}
        for side in (left, right)
    )
    return {k: (a[k], b[k]) for k in a.keys() & b.keys() if a[k] * b[k] > SPREAD_ROWS}


def join(
    left: DataFrame,
    right: DataFrame,
    how: str,
    pairs: Pairs,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Join on equal column pairs.

    All left columns come first, then the right ones without the right keys, so a
    row found only on the right has null left keys. Right names that collide with
    left ones get the prefix ``right_table_``.

    Adaptive execution splits a skewed partition on the sides an outer join may
    split; ``hot_rows`` handles the others (``None`` leaves them to Spark). It splits by
    bytes read, so an inner join also deals keys that make many rows of few to tasks.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {JOIN_TYPES}, not {how!r}")
    if not pairs:
        raise ValueError("a join needs at least one pair of columns")
    # Positional inner names keep self-joins and equal names unambiguous.
    lname = {name: f"l{i}" for i, name in enumerate(left.columns)}
    rname = {name: f"r{i}" for i, name in enumerate(right.columns)}
    types = [
        _comparable(field_type(left, a), field_type(right, b), (a, b)) for a, b in pairs
    ]
    lhs, rhs = left.toDF(*lname.values()), right.toDF(*rname.values())
    lkeys, rkeys = [lname[a] for a, _ in pairs], [rname[b] for _, b in pairs]
    joined = _split_join(lhs, rhs, lkeys, rkeys, types, how, hot_rows)
    kept = output_columns(left.columns, right.columns, pairs)
    return joined.select(
        *[F.col(inner).alias(name) for name, inner in lname.items()],
        *[F.col(rname[name]).alias(out) for name, out in kept],
    )


def _split_join(lhs, rhs, lkeys, rkeys, types, how, hot_rows) -> DataFrame:
    match = reduce(
        lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(lkeys, rkeys, strict=True)]
    )
    lhash = _key_hash([F.col(k) for k in lkeys], types)
    rhash = _key_hash([F.col(k) for k in rkeys], types)
    if hot_rows is not None and how == "inner":
        return _spread_join(lhs, rhs, lkeys, rkeys, types, match, lhash, rhash)
    hot: set[int] = set()
    if hot_rows is not None and how in ("left", "full"):
        hot |= hot_keys(rhs.select(rhash.alias("k")), hot_rows)
    if hot_rows is not None and how in ("right", "full"):
        hot |= hot_keys(lhs.select(lhash.alias("k")), hot_rows)

    extra: list[DataFrame] = []
    if how == "full":
        # Rows without a key match nothing; a shuffle would put them all in one task.
        extra += [
            _padded(lhs.where(lhash.isNull()), lhs, rhs),
            _padded(rhs.where(rhash.isNull()), lhs, rhs),
        ]
        lhs, rhs = lhs.where(lhash.isNotNull()), rhs.where(rhash.isNotNull())
    if hot:
        # Hot keys as matched rows plus unmatched rows: an inner join can be split
        # on either side, and the anti joins meet one row per hot key.
        lhot = F.coalesce(lhash.isin(*hot), F.lit(False))
        rhot = F.coalesce(rhash.isin(*hot), F.lit(False))
        lh, rh = lhs.where(lhot), rhs.where(rhot)
        extra.append(lh.join(rh, match, "inner"))
        if how in ("left", "full"):
            extra.append(_padded(lh.join(rh.select(*rkeys).distinct(), match, "left_anti"), lhs, rhs))
        if how in ("right", "full"):
            extra.append(_padded(rh.join(lh.select(*lkeys).distinct(), match, "left_anti"), lhs, rhs))
        lhs, rhs = lhs.where(~lhot), rhs.where(~rhot)
    return reduce(DataFrame.unionAll, extra, lhs.join(rhs, match, how))


def _spread_join(lhs, rhs, lkeys, rkeys, types, match, lhash, rhash) -> DataFrame:
    """An inner join whose work is dealt by the rows it makes.

    The pairs of rows of a key that makes many form a grid: its rows on each side fall
    into pieces by their hash (equal rows into the same), and each cell is one piece of
    both. A row goes to all cells of its piece.
    """
    counts = _multiplied(lhs.select(lhash.alias("k")), rhs.select(rhash.alias("k")))
    if not counts:
        return lhs.join(rhs, match, "inner")
    grids = []
    for key, (a, b) in counts.items():
        cells = -(-a * b // SPREAD_ROWS)
        across = min(a, max(1, math.ceil(math.sqrt(cells * a / b))))
        grids.append((key, across, min(b, -(-cells // across))))
    grid = F.broadcast(lhs.sparkSession.createDataFrame(grids, "k long, across long, down long"))
    tasks = min(_SPREAD_TASKS, sum(across * down for _, across, down in grids))

    def dealt(side: DataFrame, keys: list[str], key_hash: Column, own: str, other: str) -> tuple[DataFrame, list[str]]:
        """Rows of the spread keys, one for each of their cells, and what they are dealt by."""
        names = [f"{own}_{i}" for i in range(len(keys))]
        # Both sides must be dealt by the very keys they are joined on, or they would be dealt again.
        same = [F.col(k) if kind is None else F.col(k).cast(kind) if kind == "bigint" else key_hash for k, kind in zip(keys, types, strict=True)]
        plain = [f.name for f in side.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
        spread = side.join(grid, key_hash == F.col("k"), "inner").select(
            *side.columns,
            *[c.alias(n) for c, n in zip(same, names, strict=True)],
            F.pmod(F.xxhash64(*plain), F.col(own)).alias(f"{own}_at"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(f"{own}_to"),
        )
        cell = [f"{own}_at", f"{own}_to"] if own == "across" else [f"{own}_to", f"{own}_at"]
        return spread.repartition(tasks, *names, *cell), [*names, *cell]

    (left, lcells), (right, rcells) = dealt(lhs, lkeys, lhash, "across", "down"), dealt(rhs, rkeys, rhash, "down", "across")
    cells = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(lcells, rcells, strict=True)])
    if not all(kind in (None, "bigint") for kind in types):
        cells &= match
    many = left.join(right.hint("merge"), cells, "inner").select(*lhs.columns, *rhs.columns)
    spread = list(counts)
    rest = lhs.where(~lhash.isin(*spread)).join(rhs.where(~rhash.isin(*spread)), match, "inner")
    return rest.unionAll(many)


def _padded(part: DataFrame, lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """One side's rows widened to the joined columns with nulls."""
    have = set(part.columns)
    return part.select(
        *[
            F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in [*lhs.schema, *rhs.schema]
        ]
    )


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both, by position, under the left names; mixed types as text."""
    if len(left.columns) != len(right.columns):
        raise ValueError(
            f"union needs equal column counts, got {len(left.columns)} and {len(right.columns)}"
        )
    lcols, rcols = [], []
    for a, b in zip(left.schema, right.schema, strict=True):
        x, y = col(a.name), col(b.name).alias(a.name)
        same = _key_group(a.dataType) == _key_group(b.dataType)
        if a.dataType != b.dataType and not same:
            x, y = x.cast("string").alias(a.name), col(b.name).cast("string").alias(a.name)
        lcols.append(x)
        rcols.append(y)
    return left.select(*lcols).unionAll(right.select(*rcols))
