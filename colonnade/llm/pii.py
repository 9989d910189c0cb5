"""Personal data: proposed spans, scored by boosted trees, selected by calibrated thresholds.

Generators with high recall propose overlapping spans of four kinds (email, ip, card,
phone): the strict formats, and looser ones such as spelled-out addresses, numbers without
a plus sign, and stretches of longer digit runs. Boosted trees over format and context
features give each proposal a probability. A kind's threshold is the lowest one that keeps
the wanted precision on proposals held back from the fit. Spans of the strict formats are
always selected; others where they reach the threshold, break no rule of their kind and
overlap no better span.

There are no labels for personal data, so the fit is supervised by the formats' own
checks: proposals that pass the strict rule of their kind are positive, proposals of the
same looks that fail it (a wrong check digit, a part over 255), that cut a run of digits or
that overlap a strict span of another kind are negative. Each positive also enters with its telltale sign hidden, so that the trees learn the
rest of its looks and context.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm import boosting
from colonnade.llm.prefix import sums_before
from colonnade.llm.shared import small_batches, working_on, written

KINDS = ("email", "ip", "card", "phone")
#: Precision that a kind's threshold has to keep on the held-back proposals.
PRECISION = 0.99

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_RUN = re.compile(r"[+0-9][+0-9\x20().-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]{2,24}){1,4}",
    re.I,
)
_GROUPED = re.compile(r"(?<![0-9.])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?(?![0-9])")
_DIALLED = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9])")
_TELLING = {
    "phone": re.compile(r"\b(?:tel|phone|call|mobile|fax|cell|whatsapp|telefon|tél)", re.I),
    "card": re.compile(r"\b(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta)", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|addr|ping|login)", re.I),
    "email": re.compile(r"\b(?:mail|contact|write|reach)", re.I),
    "other": re.compile(r"\b(?:version|v|isbn|issn|order|invoice|ref|id|page|section|no)\.? ?$", re.I),
}
_SIGHT = 24


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def _email_at(text: str, at: int, low: int) -> int:
    """Where the local part of an @ at ``at`` begins, not before ``low``."""
    while at > low and text[at - 1] in _LOCAL:
        at -= 1
    return at


def propose(text: str) -> tuple[list[Span], list[Span]]:
    """The strict spans of a text, and the other proposals (each once, none of the strict ones)."""
    strict: list[Span] = []
    loose: set[Span] = set()
    if "@" in text:
        low = 0
        for match in _DOMAIN.finditer(text):
            start = _email_at(text, match.start(), low)
            if start < match.start():
                strict.append((0, start, match.end()))
                low = match.end()
    for match in _SPELLED.finditer(text) if " at " in text or "at]" in text or "at)" in text or "at}" in text or "AT" in text else ():
        loose.add((0, match.start(), match.end()))
    for run in _RUN.finditer(text):
        at, piece = run.start(), run[0]
        if len(piece) < 7:
            continue
        if "." in piece:
            for m in _IP.finditer(piece):
                span = (1, at + m.start(), at + m.end())
                (strict.append if all(_is_byte(p) for p in m[0].split(".")) else loose.add)(span)
        for m in _CARD.finditer(piece):
            digits = digits_of(m[0])
            span = (2, at + m.start(), at + m.end())
            if 16 <= len(digits) <= 19 and luhn(digits):
                strict.append(span)
            elif len(digits) >= 12:
                loose.add(span)
                loose.update(_windows(m[0], at + m.start(), digits))
        if "+" in piece:
            for m in _PHONE.finditer(piece):
                span = (3, at + m.start(), at + m.end())
                (strict.append if 8 <= len(digits_of(m[0])) <= 15 else loose.add)(span)
            for m in _DIALLED.finditer(piece):
                loose.update(_cuts(m[0], at + m.start()))
        for m in _GROUPED.finditer(piece):
            loose.add((3, at + m.start(), at + m.end()))
    strict.sort()
    return strict, sorted(loose.difference(strict))


def _cuts(piece: str, at: int) -> Iterator[Span]:
    """A dialled number up to the end of each of its groups."""
    for m in re.finditer(r"[0-9](?![0-9])", piece):
        if 8 <= len(digits_of(piece[: m.end()])) <= 15:
            yield (3, at, at + m.end())


def _windows(piece: str, at: int, digits: str) -> Iterator[Span]:
    """Stretches inside a run that is no card itself, where they pass the check.

    Those of 13 to 19 digits in whole groups may be cards; of 16 digits also those that cut
    a group, which the fit takes as negatives.
    """
    places = [i for i, c in enumerate(piece) if "0" <= c <= "9"]
    for k in range(len(digits) - 15):
        if luhn(digits[k : k + 16]):
            yield (2, at + places[k], at + places[k + 15] + 1)
    groups = [m.span() for m in re.finditer("[0-9]+", piece)]
    for k, (start, _) in enumerate(groups):
        size = 0
        for low, high in groups[k : k + 19]:
            size += high - low
            if size > 19:
                break
            if size >= 13 and luhn(digits_of(piece[start:high])):
                yield (2, at + start, at + high)


FEATURES = (
    "kind email,kind ip,kind card,kind phone,digits,chars,groups,spaces,dots,dashes,brackets,plus,check digit,issuer digit,"
    "largest part,distinct digits,letters,domain parts,last part letters,alnum before,alnum after,joined before,joined after,"
    "told phone,told card,told ip,told email,told other"
).split(",")
#: The feature that gives a strict span of each kind away.
_SIGN = {1: ("largest part",), 2: ("check digit",), 3: ("plus",)}


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s = text[start : start + 400] if end - start > 400 else text[start:end]
    digits = digits_of(s)
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    sight = text[max(0, start - _SIGHT) : start]
    domain = s.rsplit("@", 1)[-1].split(".") if kind == 0 else []
    return [
        float(kind == 0), float(kind == 1), float(kind == 2), float(kind == 3),
        float(len(digits)), float(len(s)), float(len(groups)), float(s.count(" ")), float(s.count(".")), float(s.count("-")),
        float(s.count("(") + s.count(")")), float(s.startswith("+")), float(len(digits) > 11 and luhn(digits)),
        float(digits[:1] in ("3", "4", "5", "6")), float(max((int(g[-4:]) for g in groups), default=0)),
        float(len(set(digits))), float(sum(c.isalpha() for c in s)), float(len(domain)),
        float(bool(domain) and domain[-1].isalpha()), float(before.isalnum()), float(after.isalnum()),
        float(before in (".", "-", "/", "_", "@", "+", "=") and before != ""), float(after in ("-", "/", "_", "@", "=", "%") and after != ""),
        *(float(bool(_TELLING[k].search(sight))) for k in ("phone", "card", "ip", "email", "other")),
    ]


@dataclass
class Detector:
    """The fitted trees and each kind's threshold (above 1: no loose span of the kind is selected)."""

    trees: boosting.Boosted
    thresholds: tuple[float, ...]

    def select(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """For every text, the strict spans and all selected spans, by kind and start."""
        found = [propose(t) for t in texts]
        proposed = [(strict, [s for s in loose if not _refuted(t, s, strict)]) for t, (strict, loose) in zip(texts, found, strict=True)]
        rows = [features(t, s) for t, (_, loose) in zip(texts, proposed, strict=True) for s in loose]
        scores = iter(self.trees.probability(np.asarray(rows)) if rows else ())
        out = []
        for text, (strict, loose) in zip(texts, proposed, strict=True):
            chosen, taken = list(strict), bytearray(len(text) if loose else 0)
            for _, s, e in strict if loose else ():
                taken[s:e] = b"\1" * (e - s)
            for p, span in sorted(((next(scores), s) for s in loose), key=lambda x: (-x[0], x[1])):
                if p >= self.thresholds[span[0]] and taken.find(1, span[1], span[2]) < 0:
                    chosen.append(span)
                    taken[span[1] : span[2]] = b"\1" * (span[2] - span[1])
            out.append((strict, sorted(chosen)))
        return out


def fit(documents: DataFrame, precision: float = PRECISION) -> Detector:
    """Fit trees and thresholds on all labelled proposals of all ``documents``.

    Of every four equal proposals one is held back for the thresholds. A table without
    proposals, or without positive or negative ones, gives a detector that selects strict
    spans only.
    """
    found = written(proposals(documents), "pii-proposals")
    if found.agg(F.count_distinct("label")).first()[0] < 2:
        return Detector(boosting.fit(np.zeros((0, len(FEATURES))), np.zeros(0), trees=0), (2.0,) * len(KINDS))
    taught = written(found.withColumn("n", F.expr("n - held")).where("n > 0").mapInPandas(_with_hidden, boosting.ROWS), "pii-taught")
    edges = boosting.table_edges(taught, len(FEATURES))
    trees = boosting.fit_table(written(boosting.table_codes(taught, edges), "pii-codes"), edges)
    return Detector(trees, thresholds(found, trees, precision))


def proposals(documents: DataFrame) -> DataFrame:
    """The labelled proposals of all texts: label, x (the features as 32-bit floats), how often (n), and how many of these are held back."""
    small_batches(documents.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("pii")
        for batch in batches:
            out = []
            for text in batch["text"]:
                strict, loose = propose(text)
                out += [(1, features(text, s)) for s in strict]
                out += [(0, features(text, s)) for s in loose if _refuted(text, s, strict)]
            yield pd.DataFrame([(y, np.asarray(x, dtype="<f4").tobytes()) for y, x in out], columns=["label", "x"])

    found = documents.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(rows, "label int, x binary")
    counted = found.groupBy("label", "x").agg(F.count("*").alias("n"))
    return counted.withColumn("held", F.expr("(n + pmod(xxhash64(label, x), 4)) div 4"))


def _with_hidden(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Proposals, and each positive again with its telltale sign hidden."""
    for batch in batches:
        batch = batch[["label", "x", "n"]]
        yield batch
        positive = batch[batch["label"] == 1]
        x = boosting.unpacked(positive["x"], "<f4", len(FEATURES)).copy()
        for kind, names in _SIGN.items():
            for name in names:
                x[x[:, kind] == 1, FEATURES.index(name)] = 0
        yield positive.assign(x=[row.tobytes() for row in x])


def _refuted(text: str, span: Span, strict: list[Span]) -> bool:
    """Whether a loose proposal is surely wrong; the others have no label.

    It is if it cuts a run of digits, overlaps a strict span of another kind, or breaks
    its kind's rule.
    """
    kind, start, end = span
    s = text[start:end]
    if kind != 0 and (text[max(0, start - 1) : start].isdigit() or text[end : end + 1].isdigit()):
        return True
    if any(k != kind and start < e and b < end for k, b, e in strict):
        return True
    if kind == 2:
        return not luhn(digits_of(s)) or len(digits_of(s)) > 19
    return kind == 1 or (kind == 3 and s.startswith("+") and not 8 <= len(digits_of(s)) <= 15)


def thresholds(found: DataFrame, trees: boosting.Boosted, precision: float) -> tuple[float, ...]:
    """For each kind, the lowest score from which the share of positives among all held-back proposals stays at least ``precision``.

    At least one half, which is also that of a kind without proposals; above 1 where no score keeps the precision.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = boosting.unpacked(batch["x"], "<f4", len(FEATURES)).astype(float)
            kind, n = x[:, : len(KINDS)].argmax(axis=1).astype(np.int32), batch["held"]
            yield pd.DataFrame({"kind": kind, "p": trees.probability(x), "n": n, "positive": n * batch["label"]})

    scored = found.where("held > 0").mapInPandas(score, "kind int, p double, n long, positive long")
    scored = scored.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    placed = sums_before(scored, [F.col("kind"), F.desc("p")], {"n_before": F.col("n"), "positive_before": F.col("positive")})
    placed = written(placed, "pii-scored")
    first = placed.groupBy("kind").agg(F.min("n_before").alias("n_first"), F.min("positive_before").alias("positive_first"))
    share = F.expr("(positive_before + positive - positive_first) / (n_before + n - n_first)")
    rows = placed.join(F.broadcast(first), "kind").groupBy("kind").agg(F.min(F.when(share >= precision, F.col("p"))).alias("p")).collect()
    lowest = {r.kind: 2.0 if r.p is None else max(0.5, r.p) for r in rows}
    return tuple(lowest.get(k, 0.5) for k in range(len(KINDS)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(documents: DataFrame, detector: Detector) -> DataFrame:
    """All columns of ``documents`` and ``strict_spans`` and ``all_spans``, as kind:start:end.

    Places count code points, the end is exclusive; spans are ordered by kind and start.
    A null text is empty and holds none. Rows with equal ids are searched each. An empty
    table gives none. Columns of these two names are replaced.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(detector)
    added = ["strict_spans", "all_spans"]
    kept = [c for c in documents.columns if c not in added]
    schema = T.StructType([*(f for f in documents.schema if f.name in kept), *(T.StructField(c, T.StringType()) for c in added)])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("pii")
        for batch in batches:
            found = shared.value.select(["" if t is None else t for t in batch["text"]])
            yield batch.assign(strict_spans=[joined(s) for s, _ in found], all_spans=[joined(a) for _, a in found])

    return documents.select(*kept).mapInPandas(search, schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def redact(documents: DataFrame, detector: Detector) -> DataFrame:
    """``documents`` with every selected span replaced by its kind in brackets, and n_chars of the new text.

    Overlapping strict spans are replaced as one, under the kind of the first. A null
    text stays null.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(detector)

    # Spans are found and replaced in one pass: each Python pass of a stage keeps a worker of its own alive on every core.
    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("pii")
        for batch in batches:
            found = shared.value.select(["" if t is None else t for t in batch["text"]])
            yield batch.assign(text=[_replaced(t, joined(spans)) if spans else t for t, (_, spans) in zip(batch["text"], found, strict=True)])

    out = documents.mapInPandas(replace, documents.schema)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType))
    return out.select(*documents.columns)


def _replaced(text: str, spans: str) -> str:
    parsed = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",")))
    out, at = [], 0
    for a, b, kind in parsed:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
