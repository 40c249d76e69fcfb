"""Line dedup by a sharded minimal perfect hash of the lines that repeat.

A line's key is the line stripped of white space, with A-Z lower-cased; it goes by 128 bits of BLAKE2b,
so different keys count as equal only where someone finds a collision. Digests and document ids are
counted by a shuffle that never carries a line. Those found in enough documents are dealt to shards, and
each shard becomes a minimal perfect hash: levels of bit arrays in which a key owns the bit that no other
key of its level falls on, so that the number of set bits before it is its place in the arrays of
fingerprints (the digest's second half), document counts and last documents. Documents then probe these
arrays; nothing is joined with lines. A line that isn't in the index passes for one that is with
probability 2**-64.

Shards are broadcast by rounds of at most ROUND keys (some 21 bytes each). Where one round holds them
all, texts are probed as they are read; else digests are written once, apart for each round, each round
probes its own, and the finds go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, give_back, small_batches, staged, table

LEAST_DOCS = 3
LEAST_CHARS = 20
#: Keys of a shard, about, and of all shards that are broadcast at once.
SHARD, ROUND = 1 << 16, 1 << 21
#: Bits of a level for each key that is still without one.
GAMMA = 2
BLANK = bytes([0x20, *range(0x09, 0x0E)])
#: Stands for a null doc_id: one document below all others.
NO_ID = -(1 << 63)
_LEVELS = 64


def line_keys(text: bytes, least: int = LEAST_CHARS) -> list[bytes | None]:
    """The key of each line; None where it has fewer than `least` code points."""
    keys = [line.strip(BLANK).lower() for line in text.split(b"\n")]  # bytes: A-Z only
    return [k if len(k) >= least and (len(k) >= 4 * least or len(k.decode()) >= least) else None for k in keys]


def digests(keys: list[bytes]) -> np.ndarray:
    """Two uint64 for each key."""
    return np.frombuffer(b"".join([hashlib.blake2b(k, digest_size=16).digest() for k in keys]), np.uint64).reshape(-1, 2)


def _slots(high: np.ndarray, low: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
    """Where keys fall in a level of so many bits."""
    z = high ^ (low * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 3)) % (1 << 64)))
    z ^= z >> np.uint64(31)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    return ((z >> np.uint64(8)) % np.asarray(sizes, np.uint64)).astype(np.int64)


def build_shard(high: np.ndarray, low: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(words of each level, bits of all levels as uint64 words, the keys in the order of their places)."""
    left, sizes, bits, order = np.arange(len(high)), [], [], []
    while len(left):
        if len(sizes) == _LEVELS:
            raise ValueError("keys of a shard repeat")
        words = -(-GAMMA * len(left) // 64)
        slot = _slots(high[left], low[left], len(sizes), words * 64)
        alone = np.bincount(slot, minlength=words * 64)[slot] == 1
        own, key = slot[alone], left[alone]
        by = np.argsort(own)
        level = np.zeros(words * 64, np.uint8)
        level[own] = 1
        bits.append(np.packbits(level, bitorder="little").view(np.uint64))
        order.append(key[by])
        sizes.append(words)
        left = left[~alone]
    return sizes, np.concatenate(bits or [np.zeros(0, np.uint64)]), np.concatenate(order or [np.zeros(0, np.int64)])


class Index:
    """Shards side by side: (shard, levels, bits, fingerprints, counts, last) rows, of `of` shards in all."""

    def __init__(self, rows: list, of: int):
        self.of = of
        self.start = np.full(of, -1, np.int64)  # a shard's first level; -1: not here
        sizes, offset, self.levels = [], [0], np.zeros(of, np.int64)
        for r in rows:
            self.start[r["shard"]], self.levels[r["shard"]] = len(sizes), len(r["levels"])
            sizes += r["levels"]
            offset += (offset[-1] + np.cumsum(r["levels"])).tolist()
        self.size, self.offset = np.array(sizes, np.int64) * 64, np.array(offset, np.int64) * 64
        join = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        self.bits = join("bits", np.uint64)
        self.fingerprints, self.counts, self.last = join("fingerprints", np.uint64), join("counts", np.int64), join("last", np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    def places(self, both: np.ndarray) -> np.ndarray:
        """The place of each digest in the arrays; -1 for those that aren't in the index."""
        high, low = both[:, 0], both[:, 1]
        found, shard = np.full(len(both), -1, np.int64), shard_of(high, self.of)
        left = np.flatnonzero(self.start[shard] >= 0)
        for level in range(_LEVELS):
            left = left[self.levels[shard[left]] > level]
            if not len(left):
                break
            at = self.start[shard[left]] + level
            bit = self.offset[at] + _slots(high[left], low[left], level, self.size[at])
            word, inside = self.bits[bit >> 6], (bit & 63).astype(np.uint64)
            here = (word >> inside) & np.uint64(1) > 0
            rank = self.before[bit[here] >> 6] + np.bitwise_count(word[here] & ((np.uint64(1) << inside[here]) - np.uint64(1)))
            same = self.fingerprints[rank] == low[left[here]]
            found[left[here][same]] = rank[same]
            left = left[~here]
        return found


def shard_of(high: np.ndarray, of: int) -> np.ndarray:
    return ((high >> np.uint64(40)) % np.uint64(of)).astype(np.int64)


def _texts(batch: pa.RecordBatch, step: int = 64) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a few rows at a time; null counts as empty."""
    for i in range(0, batch.num_rows, step):
        part = batch.column("text").slice(i, step).cast(pa.large_binary())
        yield i, [t or b"" for t in part.to_pylist()]


def line_digests(docs: DataFrame, least: int) -> DataFrame:
    """(high, low, doc): each key of a row of docs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for i, texts in _texts(batch):
                keys = [list({k for k in line_keys(t, least) if k is not None}) for t in texts]
                both = digests([k for own in keys for k in own])
                doc = np.repeat(ids[i : i + len(texts)], [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64)), pa.array(doc, pa.int64())], names=["high", "low", "doc"])
        give_back()

    return small_batches(docs.select(_doc().alias("doc"), "text")).mapInArrow(run, "high long, low long, doc long")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def repeated(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(high, low, n, last): digests of the keys found in enough documents, with their number and the largest id."""
    seen = line_digests(docs, least_chars)
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        seen = seen.distinct()  # rows of one id are one document
    return seen.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= least_docs)


def _shards(keys: DataFrame, of: int) -> DataFrame:
    """A row for each shard that has keys."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        high, low = part["high"].to_numpy(np.int64).view(np.uint64), part["low"].to_numpy(np.int64).view(np.uint64)
        levels, bits, order = build_shard(high, low)
        n, last = part["n"].to_numpy(np.int64)[order], part["last"].to_numpy(np.int64)[order]
        return pd.DataFrame({"shard": part["shard"].iloc[:1].to_numpy(), "levels": [levels], "bits": [bits.tobytes()], "fingerprints": [low[order].tobytes()], "counts": [n.tobytes()], "last": [last.tobytes()]})

    shard = F.pmod(F.shiftrightunsigned("high", 40), F.lit(of)).cast("int")
    schema = "shard int, levels array<int>, bits binary, fingerprints binary, counts binary, last binary"
    return keys.withColumn("shard", shard).groupBy("shard").applyInPandas(build, schema)


def _dropped(index: Index, keys: list[bytes | None], doc: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the lines with these keys go; of: the row of each, doc: the id of each row."""
    at = np.flatnonzero([k is not None for k in keys])
    gone = np.zeros(len(keys), bool)
    if len(at):
        place = index.places(digests([keys[i] for i in at]))
        hit = place >= 0
        at, place = at[hit], place[hit]
        gone[at] = index.last[place] != doc[of[at]]
    return gone


def _kept(text: bytes, gone: np.ndarray, hashed: bool) -> str:
    kept = text if not gone.any() else b"\n".join([line for line, g in zip(text.split(b"\n"), gone.tolist(), strict=True) if not g])
    return hashlib.sha256(kept).hexdigest() if hashed else kept.decode()


def dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, hashed: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): texts without the lines whose key, of at least so many code points,
    stands in at least so many documents, but for those of the largest doc_id that holds it. A row for each of docs.

    hashed: the SHA-256 of the text in kept_sha256 instead of text. Null and empty texts are one empty line (text
    comes back empty). Rows of one doc_id are one document; rows without one are too, below all others. Other
    columns take no part. An empty table gives no row.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    keys = staged(repeated(docs, least_docs, least_chars), "repeated-lines")
    n = keys.count()
    of = max(-(-n // SHARD), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rounds = -(-n // ROUND)
    shards = staged(_shards(keys, of), "line-shards")
    name, schema = ("kept_sha256" if hashed else "text"), f"row_ struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()}>, n_lines long, n_dropped long, kept string"
    done = lambda df: df.select("row_.doc_id", "n_lines", "n_dropped", F.col("kept").alias(name))
    carried = docs.select(F.struct("doc_id").alias("row_"), _doc().alias("doc"), "text")

    def load(turn: int):
        rows = shards.where(F.pmod("shard", F.lit(max(1, rounds))) == turn).collect()  # ROUND keys, about
        return spark.sparkContext.broadcast([r.asDict() for r in rows])

    def rows_of(batch: pa.RecordBatch, decide) -> Iterator[pa.RecordBatch]:
        """decide(first row, texts): for each text which of its lines go."""
        for i, texts in _texts(batch):
            gone = decide(i, texts)
            numbers = [pa.array([f(g) for g in gone], pa.int64()) for f in (len, lambda g: int(g.sum()))]
            kept = pa.array([_kept(t, g, hashed) for t, g in zip(texts, gone, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row_").slice(i, len(texts)), *numbers, kept], names=["row_", "n_lines", "n_dropped", "kept"])

    def judged(index: Index, ids: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
        keys = [line_keys(t, least_chars) for t in texts]
        counts = [len(k) for k in keys]
        gone = _dropped(index, [k for own in keys for k in own], ids, np.repeat(np.arange(len(texts)), counts))
        return np.split(gone, np.cumsum(counts)[:-1])

    if rounds <= 1:
        sent = load(0)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, of)
            for batch in batches:
                ids = batch.column("doc").to_numpy(zero_copy_only=False)
                yield from rows_of(batch, lambda i, texts, ids=ids: judged(index, ids[i : i + len(texts)], texts))
            give_back()

        return done(small_batches(carried).mapInArrow(probe, schema))

    # several rounds: the digests of each, then its probes, then the finds of all by document
    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "mark"))
            for i, texts in _texts(batch):
                keys = [line_keys(t, least_chars) for t in texts]
                at = [np.flatnonzero([k is not None for k in own]) for own in keys]
                both = digests([own[j] for own, where in zip(keys, at, strict=True) for j in where])
                of_row = np.repeat(np.arange(i, i + len(texts)), [len(a) for a in at])
                turn = (shard_of(both[:, 0], of) % rounds).astype(np.int32)
                columns = [ids[of_row], marks[of_row], np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64), both[:, 0].view(np.int64), both[:, 1].view(np.int64), turn]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "mark", "line", "high", "low", "turn"])
        give_back()

    marked = docs.select("doc_id", _doc().alias("doc"), F.xxhash64("text").alias("mark"), "text")
    lines_at, finds_at = fresh_path(spark, "line-digests"), fresh_path(spark, "line-finds")
    small_batches(marked.select("doc", "mark", "text")).mapInArrow(apart, "doc long, mark long, line long, high long, low long, turn int").write.partitionBy("turn").parquet(lines_at)
    lines = spark.read.schema("doc long, mark long, line long, high long, low long, turn int").parquet(lines_at)
    for turn in range(rounds):
        sent = load(turn)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, of)
            for batch in batches:
                doc, mark, line, high, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "mark", "line", "high", "low"))
                place = index.places(np.stack([high.view(np.uint64), low.view(np.uint64)], axis=1))
                hit = np.flatnonzero(place >= 0)
                hit = hit[index.last[place[hit]] != doc[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(mark[hit]), pa.array(line[hit])], names=["doc", "mark", "line"])

        lines.where(F.col("turn") == turn).mapInArrow(find, "doc long, mark long, line long").write.mode("append").parquet(finds_at)
        sent.destroy()
    finds = spark.read.schema("doc long, mark long, line long").parquet(finds_at).groupBy("doc", "mark").agg(F.collect_set("line").alias("gone"))
    with_finds = marked.join(finds, ["doc", "mark"], "left").select(F.struct("doc_id").alias("row_"), "text", "gone")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def decide(i: int, texts: list[bytes], batch=batch) -> list[np.ndarray]:
                out = [np.zeros(t.count(b"\n") + 1, bool) for t in texts]
                for flags, lines in zip(out, batch.column("gone").slice(i, len(texts)).to_pylist(), strict=True):
                    flags[lines or []] = True
                return out

            yield from rows_of(batch, decide)
        give_back()

    return done(small_batches(with_finds).mapInArrow(finish, schema))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), hashed=True)


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, u.pos, u.line, translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM docs, LATERAL (SELECT unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS pos) u
), found AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (SELECT l.*, coalesce(f.last <> l.doc_id, false) AS gone FROM lines l LEFT JOIN found f ON l.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""
