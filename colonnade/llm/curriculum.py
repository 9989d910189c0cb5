"""Mixing sources to target weights that change over the training.

Each source has a schedule: its weight at given times between 0 and 1, linear between them.
The integral of the schedule is the source's share; a source that would have to be repeated
more than ``max_repeats`` times stops there and the others share the excess by weight. A
source's documents, in a shuffled order that their contents settle, are its stream of words,
repeated as often as its target needs. A word that lies some way into the stream is due when
the integral of the schedule has come as far, so inverting the integral gives every copy of a
document its training position, and the documents are range-sorted by it.

Only DataFrame functions: the schedule's inverse is a formula per linear piece. The cumulative
sums have two levels: a source's stream is dealt into buckets by the leading digits of the
shuffled order's key, so that a source which holds a third of all rows is summed by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.prefix import sums_before
from colonnade.llm.shared import written

#: Times a document is taken at most.
MAX_REPEATS = 3
#: Documents of a bucket of the shuffled order, about.
BUCKET_ROWS = 20_000
#: What is added to the columns of the documents.
ADDED = ("size", "source_size", "target", "copies")

_KEY, _OF, _BUCKET = "__key", "__of", "__bucket"
#: Fixed value: the white space between words.
SPACES = " \t\n\x0b\x0c\r"
_SCHEDULE = "array<struct<at:double,weight:double>>"


def words(text: Column) -> Column:
    """The number of words of a text, null counting as none."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.translate(marked, SPACES, "")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A text that tells sources apart and is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def sized(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` and the keys that :func:`assign` needs; the text may then be dropped.

    An own column named ``size`` is replaced.
    """
    key = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    kept = [F.col(name) for name in docs.columns if name not in ADDED]
    return docs.select(*kept, words(F.col(text)).alias("size"), F.md5(key).alias(_KEY), _source_key(F.col(source)).alias(_OF))


def _pieces(knots: Column) -> Column:
    """The linear pieces between knots: where and at what weight each begins and ends, and the integral up to both."""
    area = lambda a, z: (a["weight"] + z["weight"]) / 2.0 * (z["at"] - a["at"])

    def longer(found: Column, i: Column) -> Column:
        a, z = F.get(knots, i), F.get(knots, i + 1)
        done = F.coalesce(F.get(found, F.size(found) - 1)["until"], F.lit(0.0))
        piece = F.struct(
            a["at"].alias("at"), z["at"].alias("end"), a["weight"].alias("first"), z["weight"].alias("last"),
            done.alias("since"), (done + area(a, z)).alias("until"),
        )
        return F.concat(found, F.array(piece))

    empty = F.array().cast("array<struct<at:double,end:double,first:double,last:double,since:double,until:double>>")
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(knots) - 2, F.lit(0))), empty, longer)


def _due(pieces: Column, demand: Column) -> Column:
    """The time at which the integral of the schedule reaches ``demand``."""
    inside = F.filter(pieces, lambda p: p["until"] > demand)
    # Rounding may put the last words a hair beyond the whole integral.
    piece = F.coalesce(F.get(inside, F.lit(0)), F.get(pieces, F.size(pieces) - 1))
    left = demand - piece["since"]
    slope = (piece["last"] - piece["first"]) / (piece["end"] - piece["at"])
    root = F.sqrt(F.greatest(piece["first"] * piece["first"] + 2.0 * slope * left, F.lit(0.0)))
    return F.when(left <= 0, piece["at"]).otherwise(
        F.least(piece["at"] + F.try_divide(2.0 * left, piece["first"] + root), piece["end"])
    )


def targets(sources: DataFrame, total: int | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (a key, ``source_size``, ``weight``) with ``target``, the words to take of each.

    Targets are in proportion to the weights but never above ``max_repeats`` times the size;
    what is above is shared again by weight until none is. Sources in the order of size per
    weight reach their bounds one after the other, so one pass over cumulative sums settles
    all. ``total`` is the words to take, all words if None; less if the bounds do not allow it.
    """
    bound = (F.col("source_size") * F.lit(max_repeats)).cast("double")
    of = sources.withColumn("__bound", bound).where("weight > 0")
    if total is None:
        total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    wanted = F.lit(float(total))
    ratio = F.try_divide(F.col("__bound"), F.col("weight"))
    placed = sums_before(of, [ratio, F.col(_OF)], {"__taken": F.col("__bound"), "__passed": F.col("weight")})
    whole = of.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    rest = F.lit(float(whole)) - F.col("__passed")
    bounded = placed.withColumn("__full", F.col("__bound") * rest <= F.col("weight") * (wanted - F.col("__taken")))
    free = ~F.col("__full")
    left = bounded.agg(
        F.coalesce(F.sum(F.when(F.col("__full"), F.col("__bound"))), F.lit(0.0)).alias("taken"),
        F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0.0)).alias("weight"),
    ).first()
    share = F.try_divide(F.col("weight") * F.lit(float(total) - left["taken"]), F.lit(left["weight"]))
    found = bounded.select(_OF, F.when(F.col("__full"), F.col("__bound")).otherwise(share).alias("target"))
    return sources.join(found, _OF, "left").fillna(0.0, ["target"])


def assign(docs: DataFrame, schedules: DataFrame, total: int | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Each document with its source's target and the copies that the mix takes of it.

    ``docs`` comes from :func:`sized`; ``schedules`` has a row per source (null for documents
    without one): ``source`` and ``knots``, an array of (at, weight) by rising ``at`` from 0 to
    1, weights not negative. A source without a schedule weighs nothing.

    Adds ``source_size``, ``target`` and ``copies``, an array of (epoch, words, position),
    empty where nothing is taken. The copy in which a source's target ends counts only up to
    it, so every source comes within a word of its target. Documents without words have no
    copies. Of rows that repeat an id and a text either may come first. An empty table gives
    an empty table.
    """
    sources = docs.groupBy(_OF).agg(F.sum("size").alias("source_size"))
    known = schedules.select(_source_key(F.col("source")).alias(_OF), _pieces(F.col("knots").cast(_SCHEDULE)).alias("__pieces"))
    weight = F.coalesce(F.element_at("__pieces", -1)["until"], F.lit(0.0))
    aimed = targets(written(sources.join(known, _OF, "left").withColumn("weight", weight), "mix-sources"), total, max_repeats)

    rows = docs.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    # The key's leading digits, scaled: a bucket holds a stretch of the key order.
    bucket = F.floor(F.conv(F.substring(_KEY, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int")
    dealt = docs.withColumn(_BUCKET, bucket)
    # One row per bucket of a source: the words before it, and the source's schedule and target.
    earlier = Window.partitionBy(_OF).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(_OF, _BUCKET).agg(F.sum("size").alias("__n"))
        .select(_OF, _BUCKET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
        .join(aimed.withColumnRenamed("weight", "__weight"), _OF)
    )
    within = Window.partitionBy(_OF, _BUCKET).orderBy(_KEY).rowsBetween(Window.unboundedPreceding, -1)
    streamed = dealt.withColumn("__inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = streamed.join(offsets, [_OF, _BUCKET]).withColumn("__start", F.col("__before") + F.col("__inside"))

    quota = F.floor("target")

    def copy(epoch: Column) -> Column:
        start = epoch * F.col("source_size") + F.col("__start")
        taken = F.greatest(F.least(F.col("size"), quota - start), F.lit(0)).cast("long")
        demand = F.try_divide(start.cast("double") * F.col("__weight"), F.col("target"))
        return F.struct(epoch.cast("int").alias("epoch"), taken.alias("words"), _due(F.col("__pieces"), demand).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), copy), lambda c: c["words"] > 0)
    return placed.select(*docs.columns, "source_size", "target", copies.alias("copies"))


def training_order(assigned: DataFrame) -> DataFrame:
    """A row per copy that the mix takes, sorted by position: the columns of the documents, epoch, words, position."""
    kept = [name for name in assigned.columns if name not in (*ADDED, _OF, "epoch", "words", "position")]
    copies = assigned.select(*kept, F.inline("copies"))
    return copies.orderBy("position", _KEY, "epoch").drop(_KEY)


def mix(docs: DataFrame, schedules: DataFrame, total: int | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents in training order, repeated and cut as the schedules ask; see :func:`assign`."""
    return training_order(assign(sized(docs), schedules, total, max_repeats))


def constant(source: Column, weight: Column) -> list[Column]:
    """The columns of a schedule that keeps one weight."""
    return [source.alias("source"), F.array(*[F.struct(F.lit(at).alias("at"), weight.cast("double").alias("weight")) for at in (0.0, 1.0)]).alias("knots")]


def bent(source: Column, weight: Column, late: Column, low: float = 0.5, high: float = 2.5) -> list[Column]:
    """The columns of a schedule with one half at ``low`` times the weight and a ramp from or to ``high`` times.

    Sources that are ``late`` rise in the second half, the others fall in the first. With
    these bounds the integral is the weight.
    """
    def knot(at: float, share: Column) -> Column:
        return F.struct(F.lit(at).alias("at"), (weight.cast("double") * share).alias("weight"))

    first, last = F.when(late, low).otherwise(high), F.when(late, high).otherwise(low)
    return [source.alias("source"), F.array(knot(0.0, first), knot(0.5, F.lit(low)), knot(1.0, last)).alias("knots")]


def ranked_schedules(docs: DataFrame, weights: Sequence[float], source: str = "source") -> DataFrame:
    """Schedules for the sources of ``docs`` by code point, null last: the weights in turn, rising and falling by turns."""
    names = docs.select(F.col(source).cast("string").alias("source")).distinct()
    ranked = sums_before(names, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    each = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    return ranked.select(*bent(F.col("source"), each, F.col("rank") % 2 == 1))
