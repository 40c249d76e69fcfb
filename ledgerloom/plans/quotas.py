"""Reports on quotas and on the revision feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..operators import quotas as Q
from ..operators.feeds import changes
from ..operators.staging import staged, staged_path
from ..sources import derived
from ..sources.readers import supplemented
from ..streaming.revisions import tell, told


def quota_cards(spark, sf_dir) -> DataFrame:
    """Cards of every snapshot; where the primary feed lacks claude, it comes from the secondary one."""
    every = derived.quotas(spark, sf_dir)
    primary = every.where("NOT (provider = 'claude' AND dayofmonth(to_date(day)) % 2 = 0)")
    place = F.row_number().over(W.partitionBy("day").orderBy("rank", "provider", "delivered"))
    return Q.cards(supplemented(primary, every, "claude", ["day"])).withColumn("place", place)


def public_quota(spark, sf_dir) -> DataFrame:
    quotas = derived.quotas(spark, sf_dir)
    return Q.public_view(quotas.select("day").distinct(), quotas)


def quota_keeper(spark, sf_dir) -> DataFrame:
    return Q.kept(derived.quotas(spark, sf_dir))


def revision_feed(spark, sf_dir) -> DataFrame:
    """What subscribers are told: each new pair of revisions, and a reset where either falls back."""
    return changes(derived.revisions(spark, sf_dir))


def revision_feed_in_batches(spark, sf_dir) -> DataFrame:
    """The same from four batches, a seventh of whose rows come one batch late, and the last of which settles all."""
    rows, path = derived.revisions(spark, sf_dir), staged_path(spark)
    block = (rows.agg(F.max("id")).first()[0] or 0) // 3 + 1
    rows = staged(rows.withColumn("at", F.floor(F.col("id") / block) + F.when(F.col("id") % 7 == 3, 1).otherwise(0)))
    for number in range(4):
        tell(rows.where(F.col("at") == number).drop("at"), path, number, 2 * block if number < 3 else 0)
    return told(spark, path)


QUERIES = {f.__name__: f for f in (quota_cards, public_quota, quota_keeper, revision_feed, revision_feed_in_batches)}
