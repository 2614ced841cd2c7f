"""Size checks in front of every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Limits


def fits(df: DataFrame, limits: Limits = Limits()) -> bool:
    """Whether a frame is small enough, in rows and in bytes, to be sent to every executor.

    Counts at most one row more than the bound, so the check itself stays cheap on a large frame.
    """
    width = F.length(F.to_json(F.struct("*")))
    rows, size = df.limit(limits.broadcast_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= limits.broadcast_rows and size <= limits.broadcast_bytes


def small_side(df: DataFrame, proven: bool | None = None, limits: Limits = Limits()) -> DataFrame:
    """Broadcast hint for a side proven small; otherwise the frame unchanged, for a shuffled join under AQE.

    `proven` hands down a check made on the frame this one was derived from.
    """
    if proven is None:
        proven = fits(df, limits)
    return F.broadcast(df) if proven else df
