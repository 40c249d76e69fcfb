"""A corpus in five stages: quality, near-duplicates, repeated passages, the mix of sources, packing.

Each stage takes all that the one before kept. Rows that a stage drops are those it judges: texts the
quality classifier scores below its threshold, all but one document of each near-duplicate group, texts
whose every word repeats an earlier passage, documents that the mix takes no copy of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, nearcopies, packing, quality, substring
from ledgerloom.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; labels outside the held-out fold are learned from."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or
    more: that of smallest id, null ids last. Of rows of equal id and text the least stays."""
    del spark, sf_dir
    found = nearcopies.kept(docs)
    key = list(nearcopies.KEY)
    rows = docs.select(*nearcopies.key(), *COLUMNS).join(found, key)
    least = F.min(F.struct("lang", "source", "n_chars", "doc_id", "text"))
    one = rows.where("many").groupBy(*key).agg(least.alias("r")).select("r.*")
    return rows.where("NOT many").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier; those that lose every word go."""
    del spark, sf_dir
    kept = substring.dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return kept.where("text IS NULL OR text <> ''").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    del spark, sf_dir
    return mixing.mix_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    del spark, sf_dir
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), tasks=packing.fewer_tasks(docs)))


STAGES = [
    ("quality", good_quality),
    ("near duplicates", without_near_copies),
    ("repeated passages", without_repeats),
    ("mix", mixed),
    ("pack", packed),
]
#: SQL has neither the classifier nor MinHash nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
