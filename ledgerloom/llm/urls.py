"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

A key is a host with a path prefix ("example.com/en/7"). Level 1 of a cascade holds the listed keys,
level 2 those keys of the corpus that level 1 takes for listed and are not, level 3 those listed that
level 2 takes for false, and so on until a level has no false positive. For every key of the corpus
the first level that lacks it tells whether it is listed, exactly and without a join.

The levels' size follows the list, not the corpus: level 1 is sized so that it passes about as many
false keys as there are listed ones. Their bits are literals of the plan; a list whose literals would be too
long is split, and each part makes a cascade and a round over the urls of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"),
    ("block", "example.net/de/8"), ("block", "org/es/"),
)
#: A level's bits, about, at most; a list that needs more is split by a hash, and its parts are looked up in rounds.
MAX_BITS = 1 << 26
HASHES = 3


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Null, or without "://": both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def shapes(rules) -> list[tuple[int, int]]:
    """(labels of the host, characters of the path) of the rules."""
    return sorted({(r.split("/", 1)[0].count(".") + 1, len(r) - r.index("/")) for _, r in rules})


def candidates(host: Column, path: Column, of: list[tuple[int, int]]) -> Column:
    """The keys of a url that a rule of such shapes could equal; longest first, equal lengths by code point."""
    labels = F.split(host, r"\.")
    keys = [
        F.when(
            (F.size(labels) >= n) & (F.length(path) >= m) & (host != ""),
            F.concat(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), "."), F.substring(path, 1, m)),
        )
        for n, m in of
    ]
    if not keys:
        return F.array().cast("array<string>")
    found = F.array_compact(F.array(*[F.when(k.isNotNull(), F.struct((-F.length(k)).alias("n"), k.alias("key"))) for k in keys]))
    return F.transform(F.array_sort(found), lambda x: x["key"])


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


class Cascade:
    """Levels as (bits, words): a bit of each word is looked up by position."""

    def __init__(self, levels: list[tuple[int, dict[int, int]]]):
        self.levels = levels

    @staticmethod
    def _has(key: Column, level: int, bits: int, words: dict[int, int]) -> Column:
        text = " ".join(str(words.get(i, 0)) for i in range((bits + 63) // 64))
        array = F.split(F.lit(text), " ").cast("array<bigint>")
        hit = F.lit(True)
        for p in _positions(key, level, bits):
            hit &= F.getbit(F.element_at(array, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1
        return hit

    def lists(self, key: Column) -> Column:
        """Whether a key of the corpus is listed."""
        known = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            known = F.when(self._has(key, level, *self.levels[level]), known).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(known, F.lit(False))

    @staticmethod
    def bits(n_in: int, n_out: int, first: bool) -> int:
        """What a level of n_in keys needs."""
        false = max(n_in / max(n_out, 1), 1e-9) if first else 0.25
        return max(64, math.ceil(-HASHES * n_in / math.log(1 - min(false, 0.5) ** (1 / HASHES))))

    @classmethod
    def fit(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """From (key) tables of distinct keys."""
        others = universe.join(listed, "key", "left_anti")
        levels: list[tuple[int, dict[int, int]]] = []
        inside, outside = listed, others
        n_in, n_out = inside.count(), outside.count()
        while n_in:
            bits = cls.bits(n_in, n_out, not levels)
            level = len(levels)
            at = inside.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
            words = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS INT)))").alias("bits"))
            levels.append((bits, {r["w"]: r["bits"] for r in words.collect()}))  # bits / 64 rows at most
            passed = staged(outside.where(cls._has(F.col("key"), level, *levels[-1])), f"cascade-{level}")
            inside, outside = passed, inside
            n_in, n_out = passed.count(), n_in
        return cls(levels)


def judge(pages: DataFrame, rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    rules: pairs (action, "host/path prefix"), or a table (key, action) of any length. A rule fits its host and
    all subdomains; the longest wins, of equally long ones the first by code point, of one with both actions
    block. A url that no rule fits isn't listed: it is allowed, its rule is null. Null urls and urls without
    "://" have an empty host and path and are allowed. Equal rows are judged each; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    table_ = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(r, a) for a, r in rules], "key string, action string")
    table_ = staged(table_.groupBy("key").agg(F.max_by("action", F.col("action") == "block").alias("action")), "listed")
    if isinstance(rules, DataFrame):  # a few shapes, however many rules
        cut = F.instr("key", "/")
        found = table_.select(F.size(F.split(F.substring("key", F.lit(1), cut - 1), r"\.")).alias("n"), (F.length("key") - cut + 1).alias("m")).distinct()
        forms = sorted((r["n"], r["m"]) for r in found.collect())
    else:
        forms = shapes(rules)
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = staged(urls.withColumn("keys", candidates(F.col("host"), F.col("path"), forms)), "urls")
    universe = staged(urls.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    n = table_.count()
    rounds = min(max(1, -(-Cascade.bits(n, universe.count(), True) // max_bits)), max(1, n))
    part = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(rounds))
    urls = urls.withColumn("hits", F.array().cast("array<struct<i:int,key:string,action:string>>"))
    for k in range(rounds):
        own = lambda df, k=k: df.where(part("key") == k) if rounds > 1 else df
        listed, keys = own(table_), own(universe)
        block, allow = (Cascade.fit(staged(listed.where(F.col("action") == a).select("key"), "part"), keys) for a in ("block", "allow"))
        each = F.transform("keys", _looked_up(block, allow, part if rounds > 1 else None, k))
        urls = urls.withColumn("hits", F.concat("hits", F.filter(each, lambda x: x["action"].isNotNull())))
        if rounds > 1:
            urls = staged(urls, "url-hits")
    first = F.try_element_at(F.array_sort("hits"), F.lit(1))
    return urls.select("page_id", "host", "path", first["key"].alias("rule"), F.coalesce(first["action"], F.lit("allow")).alias("verdict"))


def _looked_up(block: Cascade, allow: Cascade, part, k: int):
    """(key, its place) -> struct(i, key, action); action is null for keys that aren't listed in part k."""

    def look(key: Column, i: Column) -> Column:
        action = F.when(block.lists(key), "block").when(allow.lists(key), "allow")
        return F.struct(i.alias("i"), key.alias("key"), (action if part is None else F.when(part(key) == k, action)).alias("action"))

    return look


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'block'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'allow'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'block'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'allow'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'block'
       ELSE 'allow' END AS verdict
FROM urls
"""
