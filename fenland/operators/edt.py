"""Exact Euclidean distance to the nearest feature cell: a pass by column with windows, one by row with an envelope."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fenland.functions.helpers import row_envelope

from .cells import KEYS


def edt(grid: DataFrame, mask: DataFrame) -> DataFrame:
    """(site_id, r, c, d) for each cell of the grid; d is null in sites without a feature."""
    marked = grid.select(*KEYS).join(mask.select(*KEYS, F.lit(True).alias("on")), KEYS, "left")
    w = Window.partitionBy("site_id", "c").orderBy("r")
    row = F.when(F.col("on"), F.col("r"))
    up = F.last(row, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(row, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("r") - up, down - F.col("r"))
    column = marked.select(*KEYS, (near * near).cast("double").alias("g2"))

    def of_row(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c")
        d2 = row_envelope(frame["c"].to_numpy(), frame["g2"].fillna(np.inf).to_numpy())
        d = pd.Series(np.sqrt(d2), index=frame.index).where(np.isfinite(d2), None)
        return frame[KEYS].assign(d=d)

    return column.groupBy("site_id", "r").applyInPandas(of_row, "site_id long, r long, c long, d double")
