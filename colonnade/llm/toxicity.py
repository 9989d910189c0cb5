"""Toxicity of texts behind a noisy channel: restore first, then score.

Writers disguise words by look-alike characters (``1d10t``), spacing (``i d i o t``,
``i.d.i.o.t``) and repetition (``idiooot``). Every character of a suspicious word opens a
few readings, each with a cost of the channel: itself, the letters it may stand for, one
or two of a long run, or nothing for a separator. Viterbi decoding finds the most likely
path through this lattice under a character trigram model of the whole corpus. The
restored words are scored by what labelled documents say about them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.shared import small_batches, working_on

#: Labelled documents that the model is fitted on at most, those with the smallest hashes.
TRAINING_ROWS = 20_000
#: Score from which a document counts as toxic.
CUT = 0.7
#: Toxic training documents that a word's sign must occur in, and its least log odds.
SIGN_DOCUMENTS, SIGN_ODDS = 3, 1.5
#: Words whose value a worker remembers; it starts anew beyond.
CACHED_WORDS = 300_000

# Letters that a character may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "*": "aeiou", "(": "c", "<": "c",
}
_SEPARATORS = frozenset(" .-_*~'/\\")
#: Log costs of the channel.
_AS_LETTER, _AS_ITSELF, _DROPPED, _SQUEEZED = -1.0, -6.0, -0.7, -0.5
#: What a path gains for each letter, so that it doesn't pay to drop letters' positions.
_PER_LETTER = 1.0

_EDGE = " .,;:?\"'()[]{}<>«»„“”‘’–—#%&=…¡¿"
_DECORATION = re.compile(r"([^\w\s])\1{2,}")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ ._*-]|[@$!|+][ ._*-]){2,}(?:[^\W_]|[@$!|+])(?!\w)")
_RUN = re.compile(r"([^\W\d_])\1\1")
_WORD = re.compile(r"[^\W\d_]+")
_CODES = 28  # 0 is no letter, 1 to 26 are a to z, 27 any other letter
_TABLE = np.zeros(256, dtype=np.int32)
_TABLE[np.arange(97, 123)] = np.arange(1, 27)
_TABLE[np.arange(65, 91)] = np.arange(1, 27)
_TABLE[128:] = 27


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else (27 if c.isalpha() else 0)


def letter_model(documents: DataFrame) -> np.ndarray:
    """Log probabilities of a character after two others, from the texts of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("toxicity")
        total = np.zeros(_CODES**3, dtype=np.int64)
        for batch in batches:
            for low in range(0, len(batch), 200):
                data = " \n".join(batch["text"].iloc[low : low + 200])
                for at in range(0, len(data), 2_000_000):
                    c = _TABLE[np.frombuffer((" " + data[at : at + 2_000_000] + " ").encode("utf-8", "surrogatepass"), np.uint8)]
                    c = c[np.concatenate([[True], (c[1:] != 27) | (c[:-1] != 27)])]  # the bytes of one letter
                    total += np.bincount((c[:-2] * _CODES + c[1:-1]) * _CODES + c[2:], minlength=_CODES**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    rows = _texts(documents).mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full(_CODES**3, 0.05)
    counts[rows["at"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=np.float64)
    counts = counts.reshape(_CODES, _CODES, _CODES)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def _texts(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select(*more, F.coalesce("text", F.lit("")).alias("text"))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For every stretch of equal characters of a lower-case token its readings, with log costs."""
    steps: list[list[tuple[str, float]]] = []
    for c, run in groupby(token):
        n = sum(1 for _ in run)
        if c.isalpha():
            steps.append([(c * n, 0.0)] if n < 3 else [(c, _SQUEEZED), (c * 2, _SQUEEZED)])
            continue
        for _ in range(min(n, 2)):
            options = [(letter, _AS_LETTER - (0.7 if len(READINGS[c]) > 2 else 0.0)) for letter in READINGS.get(c, "")]
            options.append((" ", _AS_ITSELF if options else -0.2))
            if c in _SEPARATORS:
                options.append(("", _DROPPED))
            steps.append(options)
    return steps


def decode(token: str, model: list) -> str:
    """The most likely reading of a token; letters, with spaces where it falls apart.

    ``model`` is the letter model as nested lists.
    """
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(token):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for text, cost in options:
                x, y, s = a, b, score + cost
                for c in text:
                    z = _code(c)
                    s += model[x][y][z] + (_PER_LETTER if z else 0.0)
                    x, y = y, z
                known = after.get((x, y))
                if known is None or s > known[0]:
                    after[x, y] = (s, (path, text))
        states = after
    best = max(states.items(), key=lambda kv: kv[1][0] + model[kv[0][0]][kv[0][1]][0])[1][1]
    parts = []
    while best:
        best, text = best
        parts.append(text)
    return " ".join("".join(reversed(parts)).split())


def bare(token: str) -> str:
    """A token without the marks around it."""
    return token.strip(_EDGE).rstrip("!" + _EDGE)


def suspicious(word: str) -> bool:
    """Whether a lower-case word, without marks at its edges, may be a disguise."""
    if word.isalpha():
        return _RUN.search(word) is not None
    letters = sum(c.isalpha() for c in word)
    if letters == 0 or letters == len(word):
        return False
    others = sum(c in READINGS for c in word)
    return others > 0 or letters * 2 >= len(word)


@dataclass
class Reader:
    """Restores words, remembering up to ``remembered`` of those it has seen."""

    model: list
    remembered: int = CACHED_WORDS
    memory: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def words(self, token: str) -> tuple[str, ...]:
        """The restored words of one lower-case token of a text."""
        found = self.memory.get(token)
        if found is None:
            if len(self.memory) > self.remembered:
                self.memory.clear()
            word = bare(token)
            if word.isalpha() and not _RUN.search(word):
                found = (word,)
            elif suspicious(word):
                plain = set(_WORD.findall(word))
                found = tuple(sorted({*_WORD.findall(decode(word, self.model)), *plain}))
            else:
                found = tuple(_WORD.findall(word))
            self.memory[token] = found
        return found

    def tokens(self, text: str) -> set[str]:
        """The distinct lower-case tokens of a text, with spaced-out words closed up."""
        text = text.lower()
        if "***" in text or "%%%" in text or "$$$" in text or "!!!" in text or "###" in text or "&&&" in text or "..." in text or "---" in text or "+++" in text:
            text = _DECORATION.sub(" ", text)
        found = set(text.split())
        for match in _SPACED.finditer(text):
            found.add(re.sub(r"[ ._*-]", "", match[0]))
        return found


def restore(text: str, model: list) -> str:
    """The text in lower case with disguised words restored; other words and spaces as they are."""
    reader = Reader(model)

    def one(token: str) -> str:
        word = bare(token)
        return token.replace(word, decode(word, reader.model), 1) if word and suspicious(word) else token

    text = _SPACED.sub(lambda m: re.sub(r"[ ._*-]", "", m[0]), text.lower())
    return "".join(one(t) if not t.isspace() else t for t in re.split(r"(\s+)", text))


def signs(word: str) -> list[str]:
    """What of a word may tell: the word, and its beginnings of 3 to 6 letters."""
    return [f"={word}", *(word[:k] for k in range(3, 7) if len(word) >= k)]


@dataclass
class Model:
    letters: list
    odds: dict[str, float]
    weights: np.ndarray  # the last is the constant

    def reader(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Values of tokens and features of documents, in one worker."""

    def __init__(self, model: Model):
        self.model, self.read, self.values = model, Reader(model.letters, 0), {}  # values are remembered instead

    def value(self, token: str) -> float:
        found = self.values.get(token)
        if found is None:
            if len(self.values) > CACHED_WORDS:
                self.values.clear()
            odds = self.model.odds
            found = max((odds[s] for w in self.read.words(token) for s in signs(w) if s in odds), default=0.0)
            self.values[token] = found
        return found

    def features(self, text: str) -> list[float]:
        tokens = self.read.tokens(text)
        told = sorted((v for v in map(self.value, tokens) if v > 0), reverse=True)
        top = [*told[:3], 0.0, 0.0, 0.0]
        return [top[0], top[1], top[2], np.log1p(len(told)), len(told) / (len(tokens) + 1), np.log1p(len(tokens))]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.asarray([self.features(t) for t in texts], dtype=np.float64).reshape(len(texts), 6)
        return 1 / (1 + np.exp(-np.clip(x @ self.model.weights[:-1] + self.model.weights[-1], -30, 30)))


def training_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) != 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """Learn letters from all texts and toxicity from at most ``training_rows`` labelled ones.

    Labels are taken from the rows of ``training_fold`` with a known 0 or 1; half of them
    give the odds of words, the other half the weights of a document's features. Without
    labels of both kinds every text scores the same, under one half.
    """
    spark = documents.sparkSession
    small_batches(spark)
    letters = letter_model(documents).tolist()
    known = labels.where(training_fold(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half")
    # The sample is bounded by a parameter, so it can be broadcast.
    rows = _texts(documents, "doc_id").join(F.broadcast(sample), "doc_id").select("text", "toxic", half)
    shared = spark.sparkContext.broadcast(letters)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("toxicity")
        reader = Reader(shared.value)
        for batch in batches:
            for low in range(0, len(batch), 250):
                part = batch.iloc[low : low + 250]
                seen = (Counter(), Counter())
                for text, toxic in zip(part["text"], part["toxic"], strict=True):
                    words = {w for t in reader.tokens(text) for w in reader.words(t)}
                    seen[toxic].update({s for w in words for s in signs(w)})
                seen[0].update({"": int((part["toxic"] == 0).sum())})
                seen[1].update({"": int((part["toxic"] == 1).sum())})
                names = sorted(seen[0].keys() | seen[1].keys())
                yield pd.DataFrame({"sign": names, "clean": [seen[0][s] for s in names], "toxic": [seen[1][s] for s in names]})

    counts = (
        rows.where("half = 0").select("text", "toxic").mapInPandas(tell, "sign string, clean long, toxic long")
        .groupBy("sign").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    whole = counts.where("sign = ''").first()
    odds: dict[str, float] = {}
    if whole is not None and whole.toxic and whole.clean:
        value = F.log((F.col("toxic") + 0.5) / (whole.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (whole.clean + 1.0))
        # At most some thousands of signs can be this frequent in toxic texts of a bounded sample.
        telling = counts.where((F.col("sign") != "") & (F.col("toxic") >= SIGN_DOCUMENTS)).withColumn("odds", value).where(F.col("odds") >= SIGN_ODDS)
        odds = _distinct_signs([(r.sign, int(r.toxic), float(r.odds)) for r in telling.collect()])
    model = Model(letters, odds, np.zeros(7))
    carried = spark.sparkContext.broadcast(model)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("toxicity")
        scorer = carried.value.reader()
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [[float(v) for v in scorer.features(t)] for t in batch["text"]]})

    found = rows.where("half = 1").select("text", "toxic").mapInPandas(describe, "toxic int, x array<double>").toPandas()
    weights = np.zeros(7)
    weights[-1] = -2.0
    if len(found) and found["toxic"].nunique() == 2:
        weights = _logistic(np.stack(found["x"].to_numpy()), found["toxic"].to_numpy(dtype=np.float64))
    return Model(letters, odds, weights)


def _distinct_signs(signs: list[tuple[str, int, float]]) -> dict[str, float]:
    """The odds of signs, without beginnings that (nearly) only one telling word has: they would blame others for it."""
    own: dict[str, int] = {}
    for sign, toxic, _ in signs:
        if sign.startswith("="):
            for k in range(3, min(6, len(sign) - 1) + 1):
                own[sign[1 : k + 1]] = max(own.get(sign[1 : k + 1], 0), toxic)
    return {sign: odds for sign, toxic, odds in signs if sign.startswith("=") or own.get(sign, 0) < 0.8 * toxic}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model by Newton's method, the constant last and not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge * len(x) / 100)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` and ``score`` (0 to 1) and ``predicted`` (1 from CUT on).

    Only the text counts. A null or empty text scores as one without telling words.
    Repeated rows score alike; an empty table gives none. Columns of these two names are
    replaced.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    added = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    kept = [f for f in documents.schema if f.name not in added]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in added.items())])

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("toxicity")
        scorer = shared.value.reader()
        for batch in batches:
            found = scorer.scores(["" if t is None else t for t in batch["text"]])
            yield batch.assign(score=found, predicted=(found >= CUT).astype(np.int32))

    return documents.select(*(f.name for f in kept)).mapInPandas(rate, schema)
