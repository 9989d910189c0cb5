"""Chat formatting with typed content parts.

A turn holds a text, or a list of typed parts (text, image, audio, document). A visitor
walks the parts in order, escapes texts, and puts a numbered placeholder where an
attachment stands; the attachment's reference and its expanded token count are recorded
beside the formatted turn. The template is

    <turn:ROLE>CONTENT</turn>\\n

and a backslash stands before every ``\\``, ``<`` and ``>`` of a role or text, so that no
text can form a mark and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that one unit of an attachment expands to: an image tile, a second of audio,
#: a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}

PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("ref", T.StringType()),
            T.StructField("units", T.IntegerType()),
        ]
    )
)

_TURN = re.compile(r"<turn:((?:\\.|[^\\<>])*)>((?:\\.|[^\\<]|<(?:image|audio|document):\d+>)*)</turn>\n", re.S)
_PLACEHOLDER = re.compile(r"\\.|<(?:image|audio|document):\d+>", re.S)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<>])", r"\\$1")


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*TOKENS_PER_UNIT), F.lit(False))


def _visit(part: Column, number: Column) -> Column:
    """The formatted content of one part; ``number`` counts the attachments before it."""
    placeholder = F.concat(F.lit("<"), part["type"], F.lit(":"), number.cast("string"), F.lit(">"))
    return F.when(_is_attachment(part), placeholder).otherwise(escaped(part["text"]))


def format_turns(turns: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Format every turn of ``turns`` (conv_id, turn, role, and text or parts).

    Returns conv_id, turn, role, the formatted segment, ``attachments`` (number, type,
    ref and expanded tokens, in order) and ``attachment_tokens``. The conversation's
    text is its segments joined in order of turn; attachment numbers count within a
    turn. Null texts and roles format as empty ones, null parts and parts of another
    type as their text, null units as one. Without a column ``parts`` the text is the
    only part; a turn whose parts are null falls back to its text. Columns not named
    here are ignored, unless listed in ``extra``.
    """
    text_part = F.struct(
        F.lit("text").alias("type"),
        (F.col("text") if "text" in turns.columns else F.lit(None).cast("string")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("units"),
    )
    only_text = F.array(text_part).cast(PARTS)
    parts = F.coalesce(F.col("parts").cast(PARTS), only_text) if "parts" in turns.columns else only_text
    frame = turns.select("conv_id", "turn", "role", *extra, parts.alias("parts"))
    before = lambda i: F.size(F.filter(F.slice(F.col("parts"), 1, i), _is_attachment))
    found = F.filter(F.col("parts"), _is_attachment)
    rates = F.create_map(*[F.lit(x) for pair in TOKENS_PER_UNIT.items() for x in pair])
    attachments = F.transform(
        found,
        lambda part, i: F.struct(
            i.alias("number"),
            part["type"].alias("type"),
            part["ref"].alias("ref"),
            (F.coalesce(part["units"], F.lit(1)) * rates[part["type"]]).cast("long").alias("tokens"),
        ),
    )
    content = F.array_join(F.transform(F.col("parts"), lambda part, i: _visit(part, before(i))), "")
    return frame.select(
        "conv_id",
        "turn",
        "role",
        *extra,
        F.concat(F.lit("<turn:"), escaped(F.col("role")), F.lit(">"), content, F.lit("</turn>\n")).alias("segment"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]).alias("attachment_tokens"),
    )


def unescape(text: str) -> str:
    """The text of formatted content; placeholders leave no text."""
    return _PLACEHOLDER.sub(lambda m: m[0][1] if m[0][0] == "\\" else "", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted text; raises where it is not well formed."""
    turns, at = [], 0
    while at < len(formatted):
        match = _TURN.match(formatted, at)
        if match is None:
            raise ValueError(f"no turn at position {at}")
        turns.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    return turns


SUMMARY = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, attachment_tokens long"
)


class _Digest:
    """What is read back of one conversation, segment by segment."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.tokens = conv_id, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, tokens: int) -> None:
        self.chars += len(segment)
        self.tokens += tokens
        for role, text in read_turns(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (
            self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars,
            self.loss.hexdigest(), self.chars, self.tokens,
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted segments and sum up each conversation.

    Turns go by number (null first); equal numbers go by their formatted text. The
    segments of a conversation stream past one after the other, so a conversation of any
    length needs the memory of one batch; its rows are sorted, and spilled, by Spark.
    Conversations without an id count as one. An empty table gives no rows.
    """
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, started = None, False
        for batch in batches:
            rows = []
            for conv_id, segment, tokens in zip(batch["conv_id"], batch["segment"], batch["attachment_tokens"], strict=True):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if not started or conv_id != now.conv_id:
                    if started:
                        rows.append(now.row())
                    now, started = _Digest(conv_id), True
                now.add(segment, tokens)
            yield _frame(rows)
        if started:
            yield _frame([now.row()])

    return (
        formatted.select("conv_id", "turn", "segment", "attachment_tokens")
        .repartition(n, "conv_id")
        .sortWithinPartitions("conv_id", "turn", "segment")
        .mapInPandas(digests, SUMMARY)
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])
    frame["conv_id"] = frame["conv_id"].astype("Int64")
    return frame
