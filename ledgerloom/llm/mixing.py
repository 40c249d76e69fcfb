"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document of a source expects target / source size copies. The expected copies are summed along
the source's documents (largest first, so that neighbours are alike in size), one offset per source
is added, and a document is taken once for each integer boundary its interval crosses.

No window sees a whole source: documents are ranked within (source, size class, salt) groups, and
only the groups' counts are summed over a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, staged, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Groups that all rows together are dealt into by salt, at least; sources get theirs by share.
SALTS = 64
ROWS_PER_SALT = 500_000
SEED = "mix-1"


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _without_id() -> Column:
    """Tells rows without an id apart by their text; null where there is an id."""
    return F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, size): water-filling in closed form.

    Sources in order of cap by weight reach their cap first; one is capped if its cap is at most its
    weight's part of what the earlier ones leave.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    per = per.withColumn("i", rank).withColumn("w", weight).withColumn("c", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("c") / F.col("w"), "i")
    before = F.coalesce(F.sum("c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    per = per.withColumn("level", (total - before) / onward)
    capped = F.col("c") <= F.col("level") * F.col("w")
    level = F.max(F.when(~capped, F.col("level"))).over(W.partitionBy())  # that of the first not capped
    target = F.when(capped, F.col("c")).otherwise(F.least(F.col("c"), level * F.col("w")))
    return per.withColumn("target", target).select("source", "n_docs", "source_size", "target")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """How often to take each document: doc_id, source, size, source_size, target, copies, taken.

    Null text has size 0; a null source is a source of its own, last in order; sources of size 0 are
    not taken from. Equal rows are separate documents. Null ids rank first; such rows are dealt out by
    their texts. Other columns of docs are ignored. An empty table gives an empty result. No document is taken
    more than cap times, rounded up. Reruns agree: the offset and the salts are hashes.
    """
    return _mixed(docs, weights, share, cap, seed).drop("without_id")


def _mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    rows = staged(docs.select("doc_id", "source", _size().alias("size"), _without_id().alias("without_id")), "mix-sizes")
    sources = staged(source_targets(rows, weights, share, cap), "mix-sources")
    n = rows.count()
    salts = F.lit(max(SALTS, n // ROWS_PER_SALT))
    sources = sources.select(
        F.col("source").alias("of"), "source_size", "target",
        F.ceil(salts * F.col("n_docs") / F.lit(max(n, 1))).cast("long").alias("salts"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        (_hex(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), 4) / F.lit(65536.0)).alias("offset"),
    )
    rows = rows.join(broadcast_if_small(sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    key = ["source", "class", "salt"]
    rows = rows.withColumn("class", F.floor(F.log2(F.col("size") + F.lit(1.0)) * 8)).withColumn(
        "salt", _hex(F.coalesce(F.col("doc_id").cast("string"), "without_id"), 8) % F.col("salts")
    )
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"))
    along = W.partitionBy("source").orderBy(F.desc("class"), "salt").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("salt").alias("t"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("ahead"))
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("size"), "doc_id", "without_id")))
    ranked = ranked.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("salt") == F.col("t")))
    last = F.col("ahead") + F.col("k")
    copies = F.floor(last * F.col("rate") + F.col("offset")) - F.floor((last - 1) * F.col("rate") + F.col("offset"))
    copies = F.least(copies, F.lit(math.ceil(cap)))
    return ranked.withColumn("copies", copies.cast("int")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "without_id"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, each as often as the mix takes it; all columns of docs are kept.

    Rows that agree in doc_id, source and size share the copies that the mix gives them; without an id they
    must agree in text too.
    """
    none = lambda c, value: (F.col(c).isNull(), F.coalesce(c, F.lit(value)))
    key = [*none("doc_id", 0), *none("source", ""), F.col("size"), F.coalesce("without_id", F.lit(""))]
    by = ("doc_id", "source", "size", "without_id")
    taken = _mixed(docs, **options).groupBy(*by).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    taken = taken.select(*[c.alias(f"t{i}") for i, c in enumerate(key)], "copies", "rows")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select("doc_id", "source", _size().alias("size"), _without_id().alias("without_id"), F.xxhash64("text").alias("h"), row.alias("row"))
    keyed = keyed.select(*[c.alias(f"k{i}") for i, c in enumerate(key)], "h", "row")
    same = [F.col(f"k{i}") == F.col(f"t{i}") for i in range(len(key))]
    # the join's and the window's keys are the same, so that texts are dealt out once
    each = F.row_number().over(W.partitionBy(*[f"k{i}" for i in range(len(key))]).orderBy("h"))
    times = F.floor(F.col("copies") / F.col("rows")) + F.when(each <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    out = keyed.join(taken, same).withColumn("times", times.cast("int"))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS without_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM rows GROUP BY source
), weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size::DOUBLE * 2.0::DOUBLE AS c, sum(n_docs) OVER ()::BIGINT AS n FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(c) OVER (ORDER BY c / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY c / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), flagged AS (
  SELECT *, c <= level * w AS capped, max(CASE WHEN NOT (c <= level * w) THEN level END) OVER () AS free FROM levels
), sources AS (
  SELECT source, source_size, CASE WHEN capped THEN c ELSE least(c, free * w) END AS target,
         ceil(greatest(64, n // 500000) * n_docs / n::DOUBLE)::BIGINT AS salts,
         ('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'n')), 1, 4))::BIGINT / 65536.0::DOUBLE AS off FROM flagged
), dealt AS (
  SELECT r.doc_id, r.source, r.without_id, r.size, s.source_size, s.target, s.off,
         CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
         floor(log2(r.size + 1.0::DOUBLE) * 8)::BIGINT AS class,
         ('0x' || substr(md5(coalesce(r.doc_id::VARCHAR, r.without_id)), 1, 8))::BIGINT % s.salts AS salt
  FROM rows r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class DESC, salt, size DESC, doc_id NULLS FIRST, without_id NULLS FIRST) AS k FROM dealt
)
SELECT doc_id, size, source_size, target,
       (least(floor(k * rate + off) - floor((k - 1) * rate + off), 2)::BIGINT * size)::BIGINT AS taken FROM ranked
"""
