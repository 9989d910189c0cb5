"""Similarity join of documents on word shingles, by vertical partitioning.

The shingles have one global order: rare ones first (by a counting sketch over all
documents), equal ones by hash. Two sets whose Jaccard similarity reaches the threshold
share a shingle among the first quarter or so of either set, at places that still leave
room for the overlap needed; such pairs are candidates. The order is cut into fragments,
and each set with it. For every candidate pair the overlap is counted in each fragment on
its own, where only the two short segments meet, and the partial counts are summed.

Documents with equal sets are one class from the start. Within a group of near copies, it
takes no more links than connect it: first every set is compared with one leader of each
shingle it shares, and what is compared pair by pair then are only sets that share early
shingles enough and are still in different components.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colonnade.llm.components import components
from colonnade.llm.shared import dropped, shuffle_partitions, small_batches, small_or_joined, working_on, written
from colonnade.llm.shingles import mixed, shingle_sets

#: Words of a shingle.
WIDTH = 5
#: The threshold as a fraction, 3/4: sets link if 4 * overlap >= 3 * union.
THRESHOLD = (3, 4)
#: Fragments of the global order: the last holds the frequent shingles, the others equal ranges of hashes.
FRAGMENTS = 4
#: Counters of the sketch that orders shingles by frequency, as a power of two, at most.
#: It only shapes the order; any order gives the same links.
SKETCH_BITS = 22
#: Candidate pairs (some 30 bytes each) that are broadcast to their segments at most; more are joined.
BROADCAST_PAIRS = 500_000
_SKETCH_PART = 1 << 16
#: Stands for a missing document id in minima.
_NO_ID = (1 << 63) - 1

PROFILE = "doc_id long, n long, class long, part int, counts binary"
ENTRIES = "shingle long, class long, n int, place int"
SEGMENTS = "class long, fragment int, shingles binary"


@dataclass(frozen=True)
class Rule:
    """Arithmetic of the threshold num / den on whole numbers."""

    num: int
    den: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many first shingles of a set of ``n`` any linked set must share one of."""
        return n - -(-n * self.num // self.den) + 1

    def reachable(self, room: Column, n: Column, m: Column) -> Column:
        """Whether an overlap of ``room`` links sets of sizes ``n`` and ``m``."""
        return room * (self.num + self.den) >= (n + m) * self.num


def set_class(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, equal for equal sets."""
    sums = np.zeros(len(bounds), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    square = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles) | np.uint64(1))])
    first, second = total[bounds[1:]] - total[bounds[:-1]], square[bounds[1:]] - square[bounds[:-1]]
    size = (bounds[1:] - bounds[:-1]).astype(np.uint64)
    sums = mixed(first ^ mixed(second + mixed(size)))
    return sums.view(np.int64)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def profile(documents: DataFrame, width: int, bits: int) -> DataFrame:
    """One pass over all texts: each document's set size and class, and counts of shingles by sketch slot."""
    slots = 1 << bits

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("jaccard")
        counts = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            shingles, bounds = shingle_sets(list(batch["text"]), width)
            slot, n = np.unique((shingles >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
            counts[slot] += n
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "n": np.diff(bounds), "class": set_class(shingles, bounds), "part": -1, "counts": None}
            )
        for part in range(max(1, slots // _SKETCH_PART)):
            piece = counts[part * _SKETCH_PART : (part + 1) * _SKETCH_PART]
            if piece.any():
                small = np.minimum(piece, 0xFFFFFFFF).astype(np.uint32)
                yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "n": 0, "class": 0, "part": part, "counts": [zlib.compress(small.tobytes(), 1)]})

    return written(_texts(documents).mapInPandas(scan, PROFILE), "shingle-profile")


def rarity(profiled: DataFrame, bits: int) -> np.ndarray:
    """For every sketch slot, 0 for shingles of ordinary frequency, more for each doubling beyond."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), dtype=np.uint32).astype(np.int64) for c in part["counts"])
        # In doublings, one byte a slot; the driver gets a fixed number of slots.
        level = np.ceil(4 * np.log2(total + 1)).astype(np.uint8)
        return pd.DataFrame({"part": [part["part"].iloc[0]], "level": [level.tobytes()], "total": [int(total.sum())]})

    parts = profiled.where("part >= 0").groupBy("part").applyInPandas(add, "part int, level binary, total long").collect()
    level = np.zeros(1 << bits, dtype=np.uint8)
    size = min(1 << bits, _SKETCH_PART)
    for row in parts:
        level[row.part * size : (row.part + 1) * size] = np.frombuffer(row.level, dtype=np.uint8)
    # What a slot gathers by chance: the mean and a good margin of its spread.
    mean = sum(r.total for r in parts) / (1 << bits)
    ordinary = math.ceil(4 * math.log2(mean + 6 * math.sqrt(mean) + 8))
    return np.where(level > ordinary, (level - ordinary + 3) // 4, 0).astype(np.uint8)


def sketch_bits(documents: DataFrame) -> int:
    """Some slots for every eight words, at most SKETCH_BITS."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(SKETCH_BITS, max(12, math.ceil(math.log2(size / 48 + 1)))))


def entries(documents: DataFrame, rare, width: int, bits: int, rule: Rule) -> DataFrame:
    """The first shingles of every set in the global order, with their places."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("jaccard")
        levels, seen = rare.value, set()
        for batch in batches:
            shingles, bounds = shingle_sets(list(batch["text"]), width)
            names = set_class(shingles, bounds)
            # Copies in this task's texts are one set.
            fresh = np.zeros(len(names), dtype=bool)
            for i in np.flatnonzero(np.diff(bounds) > 0):
                if names[i] not in seen:
                    seen.add(int(names[i]))
                    fresh[i] = True
            sizes = np.diff(bounds)
            owner = np.repeat(np.arange(len(names)), sizes)
            keep = fresh[owner]
            owner, shingles = owner[keep], shingles[keep]
            order = np.lexsort((shingles, levels[(shingles >> np.uint64(64 - bits)).astype(np.int64)], owner))
            owner, shingles = owner[order], shingles[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
            early = place < rule.prefix(sizes)[owner]
            owner, place = owner[early], place[early]
            yield pd.DataFrame(
                {"shingle": shingles[early].view(np.int64), "class": names[owner], "n": sizes[owner].astype(np.int32), "place": place.astype(np.int32)}
            )

    return _texts(documents).mapInPandas(scan, ENTRIES)


def segments(documents: DataFrame, wanted: DataFrame, rare, width: int, bits: int, fragments: int) -> DataFrame:
    """The sets of the classes in ``wanted`` (class, doc_id of one member), cut into fragments.

    The first fragment comes for every set, the others where they hold something. A class
    comes again for each further row with that doc_id and its set.
    """
    ids = wanted.select("doc_id")
    texts = _texts(documents).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    texts = texts.join(small_or_joined(ids), "doc_id", "left_semi")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("jaccard")
        levels = rare.value
        for batch in batches:
            shingles, bounds = shingle_sets(list(batch["text"]), width)
            names = set_class(shingles, bounds)
            at = shingles >> np.uint64(64 - bits)
            fragment = (at * np.uint64(fragments - 1) >> np.uint64(bits)).astype(np.int64)
            fragment[levels[at.astype(np.int64)] > 0] = fragments - 1
            rows = []
            for i, name in enumerate(names):
                own, cut = shingles[bounds[i] : bounds[i + 1]], fragment[bounds[i] : bounds[i + 1]]
                for f in range(fragments):
                    part = own[cut == f]
                    if len(part) or f == 0:
                        rows.append((name, f, _packed(part)))
            yield pd.DataFrame(rows, columns=["class", "fragment", "shingles"])

    return written(texts.mapInPandas(scan, SEGMENTS), "shingle-segments")


def _packed(shingles: np.ndarray) -> bytes:
    """The lower 48 bits of hashes: within two segments of one fragment they tell shingles apart."""
    return shingles.astype("<u4").tobytes() + (shingles >> np.uint64(32)).astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


_PAIR = ["a", "b", "size_a", "size_b"]


def _partial_overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """For every pair and fragment that both have, the overlap of the two segments and their sizes.

    Few pairs are sent to the segments of their left sets; what moves is a left segment
    per pair and each right segment once.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("jaccard")
        for batch in batches:
            left, right = [_unpacked(x) for x in batch["left"]], [_unpacked(x) for x in batch["right"]]
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
            yield batch[[*_PAIR, "fragment"]].assign(shared=shared, seen_a=[len(x) for x in left], seen_b=[len(x) for x in right])

    left = cut.select(F.col("class").alias("a"), "fragment", F.col("shingles").alias("left"))
    right = cut.select(F.col("class").alias("b"), "fragment", F.col("shingles").alias("right"))
    met = left.join(small_or_joined(pairs.select(*_PAIR), BROADCAST_PAIRS), "a").join(right, ["b", "fragment"])
    schema = "a long, b long, size_a int, size_b int, fragment int, shared long, seen_a long, seen_b long"
    # Rows of one id and set bring a segment again, with the same count.
    return met.select(*_PAIR, "fragment", "left", "right").mapInPandas(count, schema).distinct()


@dataclass(frozen=True)
class Join:
    """What the steps of one join share."""

    documents: DataFrame
    members: DataFrame
    rare: object
    width: int
    bits: int
    rule: Rule
    fragments: int

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of candidate ``pairs`` (a, b, size_a, size_b): partial counts summed per pair.

        Only the sets that a candidate needs are cut and moved, by another pass over the texts.
        """
        pairs = written(pairs, "shingle-pairs")
        if pairs.isEmpty():
            return pairs.select("a", "b")
        asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        wanted = written(self.members.join(asked, "class", "left_semi"), "shingle-classes")
        cut = segments(self.documents, wanted, self.rare, self.width, self.bits, self.fragments)
        size_a, size_b = F.col("size_a"), F.col("size_b")
        # The first fragment's count already rules out most pairs that are not similar.
        first = _partial_overlaps(pairs, cut.where("fragment = 0"))
        room = F.col("shared") + F.least(size_a - F.col("seen_a"), size_b - F.col("seen_b"))
        left = written(first.where(self.rule.reachable(room, size_a, size_b)).select(*_PAIR, "shared"), "shingle-left")
        rest = _partial_overlaps(left, cut.where("fragment > 0")).select(*_PAIR, "shared")
        total = left.unionByName(rest).groupBy(*_PAIR).agg(F.sum("shared").alias("shared"))
        found = written(total.where(self.rule.reachable(F.col("shared"), size_a, size_b)).select("a", "b"), "links")
        for done in (pairs, wanted, cut, left):
            dropped(done)
        return found


def _possible(rule: Rule, n: Column, place: Column, m: Column, other: Column) -> Column:
    """Whether sets that share a shingle at these places can link: sizes, and the room from there on."""
    sizes = F.least(n, m) * rule.den >= F.greatest(n, m) * rule.num
    return sizes & rule.reachable(F.least(n - place, m - other), n, m)


def _star(shared: DataFrame, rule: Rule) -> DataFrame:
    """Candidate pairs of every set with the leader of each shingle it shares, the same in most shingles of a group."""
    met = shared.join(shared.groupBy("shingle").agg(F.min(F.struct("class", "n", "place")).alias("lead")), "shingle")
    met = met.where(F.col("class") != F.col("lead.class"))
    met = met.where(_possible(rule, F.col("n"), F.col("place"), F.col("lead.n"), F.col("lead.place")))
    return met.select(
        F.col("lead.class").alias("a"), F.col("class").alias("b"), F.col("lead.n").alias("size_a"), F.col("n").alias("size_b")
    ).distinct()


def _across(open_: DataFrame, rule: Rule) -> DataFrame:
    """Candidate pairs of sets that share an early shingle and are in different components.

    The shared shingles that leave room come first in the order of both sets, so their
    number and what follows the last of them bound the overlap.
    """
    left = open_.select("shingle", F.col("class").alias("a"), F.col("n").alias("size_a"), F.col("place").alias("place_a"), F.col("component").alias("of_a"))
    right = open_.select("shingle", F.col("class").alias("b"), F.col("n").alias("size_b"), F.col("place").alias("place_b"), F.col("component").alias("of_b"))
    can = _possible(rule, F.col("size_a"), F.col("place_a"), F.col("size_b"), F.col("place_b"))
    met = left.join(right, "shingle").where((F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & can)
    pairs = met.groupBy("a", "b", "size_a", "size_b").agg(
        F.count("*").alias("common"), F.max("place_a").alias("last_a"), F.max("place_b").alias("last_b")
    )
    room = F.col("common") + F.least(F.col("size_a") - F.col("last_a"), F.col("size_b") - F.col("last_b")) - 1
    return pairs.where(rule.reachable(room, F.col("size_a"), F.col("size_b"))).select("a", "b", "size_a", "size_b")


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Each entry with its set's component, in shingles that still join different components."""
    found = labels.select(F.col("node").alias("class"), "component")
    out = shared.drop("component").join(small_or_joined(found), "class", "left").withColumn("component", F.coalesce("component", "class"))
    split = out.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return written(out.join(split.select("shingle"), "shingle", "left_semi"), "shingle-open")


def link_classes(join: Join) -> DataFrame:
    """(node, component) of the classes that link with another class."""
    rule = join.rule
    early = entries(join.documents, join.rare, join.width, join.bits, rule)
    bucket = Window.partitionBy("shingle")
    shared = early.repartition(shuffle_partitions(join.documents.sparkSession), "shingle")
    shared = shared.withColumn("low", F.min("class").over(bucket)).withColumn("high", F.max("class").over(bucket))
    shared = written(shared.where("low <> high").drop("low", "high").distinct(), "shingle-entries")

    links = join.verified(_star(shared, rule))
    open_ = _labelled(shared, components(links))
    dropped(shared)
    more = join.verified(_across(open_, rule))
    dropped(open_)
    return components(links.unionByName(more))


def with_set_class(documents: DataFrame, name: str, width: int = WIDTH) -> DataFrame:
    """``documents`` with the class of each row's set in a column ``name``, null for an empty set."""
    schema = T.StructType([*documents.schema, T.StructField(name, T.LongType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("jaccard")
        for batch in batches:
            shingles, bounds = shingle_sets(["" if t is None else t for t in batch["text"]], width)
            names = pd.Series(set_class(shingles, bounds), index=batch.index, dtype="Int64")
            yield batch.assign(**{name: names.mask(np.diff(bounds) == 0)})

    small_batches(documents.sparkSession)
    return documents.mapInPandas(scan, schema)


def near_duplicates(documents: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, set_class and component_id for every row of ``documents``.

    Sets are the distinct ``width``-word shingles of the lower-cased text, or its whole
    word sequence if it is shorter; two documents link when the Jaccard similarity of
    their sets is at least ``threshold``, a fraction. The component is named by its
    smallest doc_id. Null and wordless texts have an empty set and are linked with
    nothing. Rows without an id can join a component but do not name one; a component of such
    rows alone has a null name. Repeated rows appear each. An empty table gives none.
    Other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rule = Rule(*threshold)
    bits = sketch_bits(documents)
    profiled = profile(documents, width, bits)
    rows = profiled.where("part < 0").select("doc_id", "n", "class")
    rare = spark.sparkContext.broadcast(rarity(profiled, bits))
    named = F.coalesce("doc_id", F.lit(_NO_ID))
    members = written(rows.where("n > 0").groupBy("class").agg(F.min(named).alias("doc_id")), "shingle-members")
    labels = link_classes(Join(documents, members, rare, width, bits, rule, fragments))
    labels = members.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(names, "component").select("class", "component_id")
    out = rows.join(labels, "class", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("component_id", F.lit(_NO_ID)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("class").alias("set_class"), component.alias("component_id"))
