"""Join helpers for skewed or small sides."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


class Size(NamedTuple):
    rows: int  # counted up to one past the bound
    small: bool


def measure(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> Size:
    """Measure a lookup side before it is broadcast; stops reading one row past the bound."""
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0))
    rows, used = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return Size(rows, rows <= max_rows and used <= max_bytes)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    return measure(df, max_rows, max_bytes).small


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint behind a size check; past the bound the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if is_small(df) else df
