"""What a feed of revisions tells its subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import latest_before

ROW = ("feed", "id", "data_revision", "status_revision")


def changes(rows: DataFrame) -> DataFrame:
    """ROW and kind: each pair of revisions that differs from the one before it in its feed, by id; a reset where
    either falls back."""
    pairs = rows.withColumn("pair", F.struct("data_revision", "status_revision"))
    pairs = latest_before(pairs, "feed", "id", "pair").withColumns({"d": F.col("latest.data_revision"), "s": F.col("latest.status_revision")})
    back = (F.col("data_revision") < F.col("d")) | (F.col("status_revision") < F.col("s"))
    same = (F.col("data_revision") == F.col("d")) & (F.col("status_revision") == F.col("s"))
    kind = F.when(back, "epoch_reset").when(~F.coalesce(same, F.lit(False)), "revision")
    return pairs.withColumn("kind", kind).where("kind IS NOT NULL").drop("pair", "latest", "d", "s")
