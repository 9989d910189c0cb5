"""The Parquet sink."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

from colonnade.types import check_distinct_names

_VERSION = re.compile(r"-[0-9a-f]{12}$")


def new_path(path: str) -> str:
    """A fresh path beside ``path``, for the next version of the same table."""
    stem = path.rstrip("/").removesuffix(".parquet").removesuffix(".version")
    return f"{_VERSION.sub('', stem)}-{uuid.uuid4().hex[:12]}.parquet"


def write_table(df: DataFrame, path: str, files: int | None = None) -> str:
    """Write snappy Parquet to a path that must not exist yet.

    Files come out as the plan is partitioned; ``files`` rebalances to that many.
    Refusing existing paths keeps a plan from overwriting a table it still reads.
    """
    check_distinct_names(df.columns)
    out = df if files is None else df.repartition(files)
    out.write.option("compression", "snappy").parquet(path)
    return path
