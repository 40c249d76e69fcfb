"""Phrase collocations by prefix-free parsing.

Each text, as a sequence of words and piece ends, is parsed into chunks: a chunk begins where a hash of
three consecutive tokens is divisible by PERIOD, and runs to the end of the next such triple, so
neighbouring chunks share three tokens and equal passages give equal chunks. The dictionary has each
distinct chunk of a language once, with the number of times that it stands in the parse. A phrase of up to
four words that starts in a chunk before its last three tokens lies within it; one that starts there belongs
to the next chunk. So phrases are counted in distinct chunks, weighted, each occurrence once.

Frequent phrases are found by length: a phrase is only counted where the shorter ones in it are frequent.
What is known as frequent is sent to tasks as a bitmap of hashes of at most FILTER bits, which can let too
many through but loses none; in the end the phrases themselves are grouped and counted exactly.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import give_back, small_batches, staged, table

#: Fixed by the chunks' overlap: phrases have at most OVERLAP + 1 words.
OVERLAP = 3
LONGEST = 4
PERIOD = 32
#: A chunk is ended after so many tokens, trigger or not.
CHUNK = 2048
LEAST = 30
#: A phrase goes if a longer one has at least this many hundredths of its occurrences.
SHADOW = 80
FIRST = 2000
UNKNOWN = "und"
#: Bits of a bitmap at most (32 MB).
FILTER = 1 << 28
#: Tokens that a task counts at once, about.
BLOCK = 1 << 21
SALTS = 64
_CLEAN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b"\n"
_SEED = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words; a newline stands where a piece ends."""
    found = [t for t in text.translate(_CLEAN).replace(b"\n", b" \n ").split(b" ") if t]
    return [t for t, before in zip(found, [_END, *found], strict=False) if t != _END or before != _END]


def chunks(words: list[bytes], period: int = PERIOD, most: int = CHUNK) -> list[bytes]:
    """The parse: chunks of words and piece ends, each with the first three tokens of the next; three ends close the last."""
    if not words:
        return []
    words = [*words, *[_END] * OVERLAP]
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    n = len(words) - OVERLAP
    triple = (h[:n] * np.uint64(0x9E3779B1) + h[1 : n + 1]) * np.uint64(0x85EBCA77) + h[2 : n + 2]
    triple ^= triple >> np.uint64(29)
    triple *= np.uint64(0xBF58476D1CE4E5B9)
    starts = np.flatnonzero((triple >> np.uint64(33)) % np.uint64(period) == 0)
    starts = np.concatenate([[0], starts[starts > 0]])
    lengths = np.diff(np.append(starts, n))
    if lengths.max() > most:
        starts = np.concatenate([np.arange(a, a + k, most) for a, k in zip(starts.tolist(), lengths.tolist(), strict=True)])
    edges = starts.tolist() + [n]
    return [b" ".join(words[a : b + OVERLAP]) for a, b in zip(edges, edges[1:], strict=False)]


def dictionary(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """(lang, chunk, n): each distinct chunk of a language and how often it stands in the parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, found = batch.slice(i, 64), Counter()
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.large_binary()), strict=True):
                    own = chunks(tokens(text.as_py() or b""), period)
                    for a in range(0, len(own), 1 << 16):  # a very long text in parts
                        found.update((lang, c) for c in own[a : a + (1 << 16)])
                        if len(found) > 1 << 16:
                            yield _counted(found)
                            found = Counter()
                yield _counted(found)
        give_back()

    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    return small_batches(rows).mapInArrow(run, "lang string, chunk binary, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def _counted(found: Counter) -> pa.RecordBatch:
    langs, parts = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary()), pa.array(list(found.values()), pa.int64())], names=["lang", "chunk", "n"])


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A hash of a sequence from that of its beginning and the next part."""
    h = (h + _SEED) * np.uint64(0xBF58476D1CE4E5B9) ^ more
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each distinct key stands first, its weight in all, for each key the number of its kind)."""
    order = np.argsort(keys)
    new = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, np.int64)
    kind = np.empty(len(keys), np.int64)
    kind[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(keys))))
    return order[new], np.add.reduceat(weights[order], new) if len(new) else np.zeros(0, np.int64), kind


class Block:
    """The tokens of some chunks: for each its word, language, weight, and whether a phrase may start there."""

    def __init__(self, langs: list[str], parts: list[bytes], times: list[int]):
        words, names = defaultdict(count().__next__), defaultdict(count().__next__)
        every = b" ".join(parts).split(b" ")
        self.word = np.fromiter(map(words.__getitem__, every), np.int64, len(every))
        lengths = np.fromiter((p.count(b" ") + 1 for p in parts), np.int64, len(parts))
        self.lang = np.repeat(np.fromiter(map(names.__getitem__, langs), np.int64, len(langs)), lengths)
        self.weight = np.repeat(np.array(times, np.int64), lengths)
        self.words, self.langs = list(words), list(names)
        self.is_word = self.word != words.get(_END, -1)
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(every))  # tokens from here to the chunk's end
        self.starts = self.is_word & (left > OVERLAP)
        self._value = np.array([zlib.crc32(w) << 32 | zlib.adler32(w) for w in self.words], np.uint64)
        self._of_lang = np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64)

    def after(self, flags: np.ndarray, k: int) -> np.ndarray:
        """flags of the token k places on; none beyond the end."""
        return np.append(flags[k:], np.zeros(min(k, len(flags)), bool))

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the phrases of n words that start at `at`."""
        h = _mixed(np.full(len(at), n, np.uint64), self._of_lang[self.lang[at]])
        for j in range(n):
            h = _mixed(h, self._value[self.word[at + j]])
        return h

    def distinct(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct phrase of n words at `at`, its weight)."""
        key, most = self.lang[at], len(self.langs)
        for j in range(n):
            if most * len(self.words) >= 1 << 62:
                key, most = _summed(key, self.weight[at])[2], len(at)
            key, most = key * len(self.words) + self.word[at + j], most * len(self.words)
        first, weight, _ = _summed(key, self.weight[at])
        return at[first], weight

    def known(self, n: int, bitmap: np.ndarray) -> np.ndarray:
        """Whether a phrase of n words that bitmap knows starts at each token."""
        inside = self.is_word.copy()
        for j in range(1, n):
            inside &= self.after(self.is_word, j)
        at = np.flatnonzero(inside)
        bit = self.hashes(at, n) & np.uint64(len(bitmap) * 8 - 1)
        inside[at] = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return inside


def _over_blocks(parsed: DataFrame, of: Callable[[Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for column, name in zip(held, ("lang", "chunk", "n"), strict=True):
                column += batch.column(name).to_pylist()
            size += sum(map(len, held[1][-batch.num_rows :]))
            if size > 6 * BLOCK:  # some six bytes a token
                yield from of(Block(*held))
                held, size = ([], [], []), 0
        if held[0]:
            yield from of(Block(*held))
        give_back()

    return parsed.mapInArrow(run, schema)


def _hashed(parsed: DataFrame, n: int, shorter: DataFrame | None, least: int) -> DataFrame:
    """(h): hashes of at least all phrases of n words with `least` occurrences."""
    sent = _bitmap(shorter) if shorter is not None else None

    def of(block: Block) -> Iterator[pa.RecordBatch]:
        good = block.starts
        if sent is not None:
            part = block.known(n - 1, sent.value)
            good = good & part & block.after(part, 1)
        at, weight = block.distinct(np.flatnonzero(good), n)
        yield pa.RecordBatch.from_arrays([pa.array(block.hashes(at, n).view(np.int64)), pa.array(weight)], names=["h", "c"])

    rows = _over_blocks(parsed, of, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return staged(rows.where(F.col("c") >= least).select("h"), f"frequent-{n}")


def _bitmap(hashes: DataFrame):
    """A broadcast bitmap of hashes, of some 64 bits for each up to FILTER bits."""
    bits = min(FILTER, max(1 << 16, 1 << (64 * hashes.count()).bit_length()))
    page = 1 << 15

    def pages(part: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(page, np.uint8)
        flags[part["inside"].to_numpy()] = 1
        return pd.DataFrame({"page": part["page"].iloc[:1].to_numpy(), "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    where = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    spots = hashes.select(where.alias("b")).distinct().select(F.expr(f"b div {page}").alias("page"), F.expr(f"b % {page}").cast("int").alias("inside"))
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in spots.groupBy("page").applyInPandas(pages, "page long, bits binary").collect():  # FILTER bits at most
        bitmap[r["page"] * page // 8 :][: page // 8] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def frequent(parsed: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of phrases of 1 to 4 words with at least `least` occurrences, (lang, n) with all words)."""
    ones = _hashed(parsed, 1, None, least)
    twos = _hashed(parsed, 2, ones, least)
    one, two, three = _bitmap(ones), _bitmap(twos), _bitmap(_hashed(parsed, 3, twos, least))

    def of(block: Block) -> Iterator[pa.RecordBatch]:
        ends = np.flatnonzero(block.starts)
        lang, total = np.unique(block.lang[ends]), np.bincount(block.lang[ends], block.weight[ends])
        out: tuple[list, list, list, list] = ([block.langs[x] for x in lang], [None] * len(lang), [0] * len(lang), [int(total[x]) for x in lang])
        known = [block.known(n, x.value) for n, x in ((1, one), (2, two), (3, three))]
        for n in range(1, LONGEST + 1):
            good = block.starts & (known[n - 1] if n < LONGEST else known[2] & block.after(known[2], 1))
            at, weight = block.distinct(np.flatnonzero(good), n)
            for column, values in zip(out, ([block.langs[x] for x in block.lang[at]], [b" ".join([block.words[w] for w in row]).decode() for row in block.word[at[:, None] + np.arange(n)].tolist()], [n] * len(at), weight.tolist()), strict=True):
                column += values
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "words", "f"])

    counted = _over_blocks(parsed, of, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    counted = staged(counted.where((F.col("words") == 0) | (F.col("f") >= least)), "phrases")
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("f").alias("n"))


def scored(phrases: DataFrame, shadow: int = SHADOW) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more that no longer one overshadows.

    The score is that of the lowest-scoring cut, ties to the first. All arithmetic is in integers: products as
    decimals of 38 digits.
    """
    word = F.split("phrase", " ")
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    long = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), word.alias("w"))
    cut = long.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    part = lambda side, f: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b"))
    subs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    longer = long.where("words > 2").select("lang", "a", F.explode(F.array_distinct(subs)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    seen = best.join(longer, ["lang", "phrase"], "left")
    hidden = F.coalesce(F.expr(f"cast(100 as decimal(38,0)) * cast(over as decimal(19,0)) >= cast({shadow} as decimal(38,0)) * cast(a as decimal(19,0))"), F.lit(False))
    return seen.where(~hidden).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, shadow: int = SHADOW) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two to four words by score.

    Null texts and those without a word count nothing; a null lang is `und`, together with that text. Repeated rows
    count each time. Columns other than lang and text take no part. An empty table gives no row.
    """
    parsed = staged(dictionary(docs), "chunks")
    phrases, totals = frequent(parsed, least)
    good = scored(phrases, shadow)
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = good.withColumn("rank", F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= first)
    top = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sized AS (SELECT lang, unnest([1, 2, 3, 4]) AS words, w FROM worded WHERE len(w) > 0),
placed AS (SELECT lang, words, w, unnest(range(1, len(w) - words + 2)) AS i FROM sized WHERE len(w) >= words),
counted AS (SELECT lang, words, array_to_string(w[i : i + words - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang),
freq AS (SELECT * FROM counted WHERE f >= 30),
long AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE words > 1),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM long),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
subs AS (
  SELECT lang, a, array_to_string(w[i : j], ' ') AS phrase
  FROM (SELECT *, unnest(range(i + 1, words + 1)) AS j FROM (SELECT *, unnest(range(1, words)) AS i FROM long WHERE words > 2)) WHERE j - i + 1 < words
), over AS (SELECT lang, phrase, max(a) AS a FROM subs GROUP BY ALL),
good AS (
  SELECT b.* FROM best b LEFT JOIN over o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 80 * b.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM good)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
