"""Substring dedup with a log-structured index of window fingerprints.

A window is `window` consecutive words. Of each window's word n-grams the one with the least hash is
its anchor (equal windows choose alike), so a text has about one anchor for eight words. Consecutive
windows of one anchor are a stretch. The index is a folder of immutable runs. A run has the stretches
of one or more batches, sorted by the hash of the anchor in buckets, and the texts they are of. A new
batch makes a run of its own, which is merge-joined with every run before it, bucket by bucket. Anchors
that are frequent beyond a bucket's share are spread over all buckets and met by broadcasts of their short
list. What shares an anchor is verified: equal stretches by a digest of all their words, and of those that
are first of their kind, but share the anchor with others, each window by a digest of its own. Runs of like
size are compacted into one.

Digests are BLAKE2b of 128 bits over the words themselves: texts that differ are taken for equal only
where someone finds a collision of it, which takes some 2**64 tries.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import STEP, fresh_path, give_back, small_batches, staged, table

WINDOW = 20
GRAM = 6
#: An anchor of more places than this is judged by partial aggregates and a join that Spark can split.
HOT = 100_000
#: Anchors that have more than a bucket's share of the places, divided by this, are spread; a run has at most HEAVY
#: times its buckets of them. They are counted in one of SAMPLED texts, where those of under LEAST don't count.
HEAVY, SAMPLED, LEAST = 4, 64, 32
#: Batches in which the query feeds its table to the index.
BATCHES = 2
#: So many runs of like size are compacted into one.
FANOUT = 4
LAST = (1 << 63) - 1
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(64)], np.uint64)
_STEP = 50_000


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams, for each window the position of its anchor)."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    h ^= h << np.uint64(31)
    n = len(words) - gram + 1
    g = np.zeros(n, np.uint64)
    for j in range(gram):
        g += h[j : j + n] * _FACTORS[j]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(axis=1)
    return g, least + np.arange(len(least))


def stretches(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the anchor, code) of each stretch; code: first window * most windows of a stretch + windows - 1."""
    g, at = anchors(words, window, gram)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    return g[at[first]].view(np.int64), first * (window - gram + 1) + count - 1


def covered(n: int, first: np.ndarray, count: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words `count` windows from `first` on cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + count - 1 + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _each(column, of) -> pa.Array:
    """of(list of values) for a few values at a time, as one array."""
    parts = [of(column.slice(i, STEP).to_pylist()) for i in range(0, len(column), STEP)]
    return pa.concat_arrays(parts) if parts else of([])


def _packed(text: Column | str) -> Column:
    """Texts compressed for a shuffle; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        return _each(texts, lambda ts: pa.array([pack(t.encode()) if t is not None else None for t in ts], pa.binary()))

    return F.arrow_udf(run, "binary")(text)


def _unpacked(data: bytes | None) -> bytes | None:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data) if data is not None else None


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _digests(texts: DataFrame, window: int, span: int, whole: bool) -> DataFrame:
    """(d, g, id, no, at, n) from (no, id, g, z, at, n): digests of the stretches' words, if `whole`, or else of
    each of their windows; at: the stretch or window as a code."""
    schema = "d binary, g int, id long, no long, at long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        for batch in batches:
            for no, doc, g, z, ats, ns in zip(*(batch.column(c) for c in ("no", "id", "g", "z", "at", "n")), strict=True):
                words = _unpacked(z.as_py()).split()
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                joined = b" ".join(words)
                at, n = np.asarray(ats.as_py(), np.int64), np.asarray(ns.as_py(), np.int64)
                first, more = at // span, at % span
                if not whole:
                    each = np.repeat(np.arange(len(at)), more + 1)
                    first, n = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1), n[each]
                    more, at = np.zeros(len(each), np.int64), first * span
                a, b = np.concatenate([[0], ends])[first].tolist(), (ends[first + more + window - 1] - 1).tolist()
                held[0] += [hashlib.blake2b(joined[x:y], digest_size=16).digest() for x, y in zip(a, b, strict=True)]
                for column, value in ((held[1], g.as_py()), (held[2], doc.as_py()), (held[3], no.as_py())):
                    column += [value] * len(at)
                held[4] += at.tolist()
                held[5] += n.tolist()
                if len(held[0]) > _STEP:
                    yield _batch(held, schema)
                    held = [[] for _ in range(6)]
        if held[0]:
            yield _batch(held, schema)
        held.clear()
        give_back()

    return texts.select("no", "id", "g", "z", "at", "n").mapInArrow(run, schema)


def _judged(found: DataFrame, span: int, hot: int, frequent: bool) -> DataFrame:
    """(no, at, n, g, later, same) of rows (d, g, id, no, at, n): whether an equal digest has an earlier place, and
    how many have it. n: places of the anchor, which bounds them."""
    place = F.struct("g", "id", F.floor(F.col("at") / span).alias("s"))
    keep = lambda df: df.select("no", "at", "n", "g", (place > F.col("first")).alias("later"), "same")
    by = W.partitionBy("d")
    if not frequent:
        return keep(found.withColumns({"first": F.min(place).over(by), "same": F.count("*").over(by)}))
    found = staged(found, "digests")  # read several times
    few, many = found.where(F.col("n") <= hot), found.where(F.col("n") > hot)
    least = many.groupBy("d").agg(F.min(place).alias("first"), F.count("*").alias("same")).withColumnRenamed("d", "e")
    few = few.withColumns({"first": F.min(place).over(by), "same": F.count("*").over(by)})
    return keep(few).unionByName(keep(many.join(least, F.col("d") == F.col("e"))))


class FingerprintIndex:
    """An index under a folder: the runs that its latest manifest names. Runs are written once and never changed;
    an add() or compact() that fails before its manifest leaves the index as it was.

    create() starts one, open() goes on with one, in any session. Each batch is later than those before it.
    """

    MANIFEST = "version long, run string, rows long, low long, high long, window int, gram int, buckets int, heavy long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.tables = spark, path, {}
        rows = spark.read.schema(self.MANIFEST).parquet(f"{path}/manifest")
        rows = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("low").collect()  # a row for each run
        self.version, self.window, self.gram, self.buckets = (rows[0][c] for c in ("version", "window", "gram", "buckets"))
        self.runs = [r.asDict() for r in rows if r["run"] is not None]
        self.span = self.window - self.gram + 1

    @classmethod
    def create(cls, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None) -> FingerprintIndex:
        """buckets: of each run; as many as the session has shuffle partitions, if not given."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        first = [(0, None, 0, 0, 0, window, gram, buckets, 0)]
        spark.createDataFrame(first, cls.MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        return cls(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        return cls(spark, path)

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}

    def _write(self, df: DataFrame, at: str, key: str, deal: bool = True) -> DataFrame:
        """df as a table in buckets of key, sorted; joins and groups by key then need no shuffle of it."""
        name = self.tables[at] = f"bucketed_{uuid.uuid4().hex}"
        df = df.repartition(self.buckets, key) if deal else df
        df.write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{at}").saveAsTable(name)
        return self.spark.table(name)

    def _read(self, at: str, columns: str, key: str) -> DataFrame:
        if at not in self.tables:
            name = self.tables[at] = f"bucketed_{uuid.uuid4().hex}"
            where = f"{self.path}/{at}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(self.tables[at])

    def _places(self, run: dict) -> DataFrame:
        """(b, f, no, at): b is the anchor; of heavy anchors that is f, which is null for others."""
        return self._read(f"{run['run']}/places", "b BIGINT, f BIGINT, no BIGINT, at BIGINT", "b")

    def _light(self, run: dict) -> DataFrame:
        return self._places(run).where("f IS NULL").select("b", "no", "at")

    def _heavy(self, run: dict) -> DataFrame:
        return self._places(run).where("f IS NOT NULL").select("f", "no", "at")

    def _heavy_counts(self, run: dict) -> DataFrame:
        """(h, m): heavy anchors of a run and their places; HEAVY * buckets rows at most for each batch in it."""
        return F.broadcast(self.spark.read.schema("h long, m long").parquet(f"{self.path}/{run['run']}/heavy"))

    def _write_places(self, found: DataFrame, heavy: DataFrame, run: dict) -> None:
        """places and heavy of a run, from (f, no, at) and (h) with the heavy anchors."""
        dealt = found.join(F.broadcast(heavy), F.col("f") == F.col("h"), "left")
        is_heavy = F.col("h").isNotNull()
        dealt = dealt.select(F.when(is_heavy, F.xxhash64("f", "no")).otherwise(F.col("f")).alias("b"), F.when(is_heavy, F.col("f")).alias("f"), "no", "at")
        places = self._write(dealt, f"{run['run']}/places", "b")
        self._heavy(run).groupBy(F.col("f").alias("h")).agg(F.count("*").alias("m")).write.parquet(f"{self.path}/{run['run']}/heavy")
        run["heavy"], run["rows"] = self._heavy_counts(run).count(), places.count()

    def _texts(self, run: dict) -> DataFrame:
        return self._read(f"{run['run']}/texts", "no BIGINT, id BIGINT, z BINARY", "no")

    def _commit(self, runs: list[dict]) -> None:
        rows = [(self.version + 1, r["run"], r["rows"], r["low"], r["high"], self.window, self.gram, self.buckets, r["heavy"]) for r in runs]
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.version, self.runs = self.version + 1, runs

    def _new_run(self, docs: DataFrame) -> tuple[dict, DataFrame]:
        """The run of a batch and its rows: (no, id, z, row), row: the columns of docs other than text."""
        window, gram = self.window, self.gram
        run = {"run": f"run-{uuid.uuid4().hex}", "low": max((r["high"] for r in self.runs), default=0)}
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
        small_batches(docs)
        rows = docs.select(
            (F.monotonically_increasing_id() + F.lit(run["low"])).alias("no"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
            _packed("text").alias("z"), rest.alias("row"),
        )
        rows = self._write(rows, f"{run['run']}/texts", "no")

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                for no, z in zip(batch.column("no"), batch.column("z"), strict=True):
                    f, at = stretches((_unpacked(z.as_py()) or b"").split(), window, gram)
                    held.append((f, np.full(len(f), no.as_py(), np.int64), at))
                    size += len(f)
                    if size > _STEP:
                        yield _batch([np.concatenate(c) for c in zip(*held, strict=True)], "f long, no long, at long")
                        held, size = [], 0
            if size:
                yield _batch([np.concatenate(c) for c in zip(*held, strict=True)], "f long, no long, at long")
            held.clear()
            give_back()

        whole = lambda df: df.select("no", "z").mapInArrow(places, "f long, no long, at long")
        seen = staged(whole(rows.where(F.pmod(F.xxhash64("no"), F.lit(SAMPLED)) == 0)).groupBy("f").agg(F.count("*").alias("n")), "frequent")
        share = (seen.agg(F.sum("n")).first()[0] or 0) / (HEAVY * self.buckets)
        heavy = seen.where(F.col("n") > max(share, LEAST)).select(F.col("f").alias("h"))
        self._write_places(whole(rows), heavy, run)
        run["high"] = max(run["low"], rows.agg(F.max("no")).first()[0] or 0) + 1
        return run, rows

    def add(self, docs: DataFrame, hot: int = HOT) -> DataFrame:
        """Index a batch. Gives its rows (no, id, z, row, stretches): what of each stands earlier, in an earlier batch
        or in this one by (doc_id, start); null if nothing does.

        Rows of equal doc_id aren't earlier than each other; null ids come last.
        """
        run, rows = self._new_run(docs)
        base, work = run["low"], f"work-{uuid.uuid4().hex}"
        runs = [*self.runs, run]
        counted = lambda df, key, n: df.groupBy(F.col(key).alias(n[0])).agg(F.count("*").alias(n[1]))
        more = lambda c: (F.col("n") + F.coalesce(c, F.lit(0))).alias("n")
        # (e, n): anchors of the batch with several places in all runs; those that are heavy in it apart
        shared, often = counted(self._light(run), "b", "en"), self._heavy_counts(run).select(F.col("h").alias("e"), F.col("m").alias("n"))
        for r in self.runs:
            old = counted(self._light(r), "b", "om")  # a merge-join of sorted buckets
            shared = shared.join(old, F.col("e") == F.col("o"), "left").select("e", more("m"))
            if run["heavy"]:
                old = counted(self._light(r).join(F.broadcast(often.select("e")), F.col("b") == F.col("e")), "b", "om")
                often = often.join(F.broadcast(old), F.col("e") == F.col("o"), "left").select("e", more("m"))
            if r["heavy"]:
                shared, often = (df.join(self._heavy_counts(r), F.col("e") == F.col("h"), "left").select("e", more("m")) for df in (shared, often))
        shared = self._write(shared.where("n > 1"), f"{work}/shared", "e", deal=False)
        often = staged(often.where("n > 1"), "often") if run["heavy"] else None
        hits = []
        for r in runs:
            hits.append(self._light(r).join(shared, F.col("b") == F.col("e")))
            if run["heavy"] and r is not run:
                hits.append(self._light(r).join(F.broadcast(often), F.col("b") == F.col("e")))
            if r["heavy"]:
                own = shared.join(self._heavy_counts(r), F.col("e") == F.col("h"), "left_semi")
                own = own if often is None else own.unionByName(often)
                hits.append(self._heavy(r).join(F.broadcast(own), F.col("f") == F.col("e")))
        marks = hits[0].select("no", "at", "n")
        for h in hits[1:]:
            marks = marks.unionByName(h.select("no", "at", "n"))
        both = shared if often is None else shared.unionByName(often)
        frequent = not both.where(F.col("n") > hot).isEmpty()
        found = _judged(self._digested(marks, runs, f"{work}/marks", base, True), self.span, hot, frequent)
        found = staged(found.where("(later AND g = 1) OR (NOT later AND same < n)"), "stretches")
        alone = self._digested(found.where("NOT later").select("no", "at", "n"), runs, f"{work}/alone", base, False)
        alone = _judged(alone, self.span, hot, frequent).where("later AND g = 1")
        later = found.where("later").select("no", "at").unionByName(alone.select("no", "at"))
        later = later.groupBy("no").agg(F.sort_array(F.collect_list("at")).alias("stretches"))
        later = self._write(later.withColumnRenamed("no", "of"), f"{work}/later", "of", deal=False)
        self._commit(runs)
        return rows.join(later, F.col("no") == F.col("of"), "left").drop("of")

    def _digested(self, marks: DataFrame, runs: list[dict], at: str, base: int, whole: bool) -> DataFrame:
        """Digests of marks (no, at, n), whose texts are in any of the runs."""
        per = marks.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("m"))
        per = self._write(per.select(F.col("no").alias("of"), "m"), at, "of", deal=False)
        texts = None
        for r in runs:
            part = self._texts(r).select("no", "id", "z").join(per.where(F.col("of").between(r["low"], r["high"])), F.col("no") == F.col("of"))
            texts = part if texts is None else texts.unionByName(part)
        texts = texts.select("no", "id", (F.col("no") >= base).cast("int").alias("g"), "z", "m.at", "m.n")
        return _digests(texts, self.window, self.span, whole)

    def compact(self, fanout: int = FANOUT) -> bool:
        """Merge the first `fanout` neighbouring runs of like size, if there are so many: none has over `fanout` times
        the rows of the others together, so a row is merged a number of times that grows as the logarithm of the
        index. The folders of the runs that were merged stay until nothing reads them; the manifest names them no more.
        """
        for i in range(len(self.runs) - fanout + 1):
            part = self.runs[i : i + fanout]
            rows = [r["rows"] for r in part]
            if max(rows) > fanout * (sum(rows) - max(rows)):
                continue
            run = {"run": f"run-{uuid.uuid4().hex}", "low": part[0]["low"], "high": part[-1]["high"]}
            together = lambda read: functools.reduce(DataFrame.unionByName, [read(r) for r in part])  # noqa: B023, E731
            heavy = together(lambda r: self._heavy_counts(r).select("h")).distinct()
            self._write_places(together(lambda r: self._places(r).select(F.coalesce("f", "b").alias("f"), "no", "at")), heavy, run)
            self._write(together(lambda r: self._texts(r).select("no", "id", "z")), f"{run['run']}/texts", "no")
            self._commit([*self.runs[:i], run, *self.runs[i + fanout :]])
            return True
        return False


def _left(z: bytes | None, codes, window: int, span: int) -> tuple[list[bytes], np.ndarray]:
    """(words, which stay) of a packed text and its stretches."""
    words = (_unpacked(z) or b"").split()
    at = np.asarray(codes if codes is not None else [], np.int64)
    return words, ~covered(len(words), at // span, at % span + 1, window)


def added(index: FingerprintIndex, docs: DataFrame, **options) -> DataFrame:
    """docs, a batch that index takes in, without the passages that stand earlier: text is replaced by the kept
    words joined by one space where words go; texts that lose nothing stay as they are, and so do null texts.
    All rows and columns stay; extra columns may have any name.
    """
    window, span = index.window, index.span

    def kept(z: bytes | None, codes: list | None) -> str | None:
        if z is None or codes is None:
            return None if z is None else _unpacked(z).decode()
        words, stay = _left(z, codes, window, span)
        return b" ".join([words[i] for i in np.flatnonzero(stay)]).decode()

    def run(packed: pa.Array, codes: pa.Array) -> pa.Array:
        both = pa.StructArray.from_arrays([packed, codes], ["z", "c"])
        return _each(both, lambda rows: pa.array([kept(r["z"], r["c"]) for r in rows], pa.string()))

    rows = index.add(docs, **options).select("row", F.arrow_udf(run, "string")("z", "stretches").alias("kept"))
    return rows.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def summarised(index: FingerprintIndex, docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of a batch that index takes in; null text has no words."""
    window, span = index.window, index.span

    def run(packed: pd.Series, codes: pd.Series) -> pd.DataFrame:
        out = []
        for z, c in zip(packed, codes, strict=True):
            words, stay = _left(z, c, window, span)
            kept = words if stay.all() else [words[i] for i in np.flatnonzero(stay)]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    found = F.pandas_udf(run, "n_words long, n_removed long, kept_sha256 string")("z", "stretches")
    rows = index.add(docs.select("doc_id", "text"), **options).select("id", found.alias("x"))
    return rows.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "x.*")


def _in_batches(docs: DataFrame, each, window: int, gram: int, batches: int, hot: int) -> DataFrame:
    """What each(index, batch, hot) gives for batches by doc_id, in turn, of a fresh index, together."""
    index = FingerprintIndex.create(docs.sparkSession, fresh_path(docs.sparkSession, "index"), window, gram)
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    out, low = None, None
    for cut in [*sorted(set(cuts or [])), None]:
        at = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
        part = docs if low is None else docs.where(at > low)
        part = part if cut is None else part.where(at <= cut)
        got = each(index, part, hot=hot)
        out, low = got if out is None else out.unionByName(got), cut
        index.compact()
    return out


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """docs without the repeated passages, all rows and columns: see added(). An empty table stays empty."""
    return _in_batches(docs, added, window, gram, batches, hot)


def summary(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs; null text has no words. An empty
    table gives an empty result."""
    return _in_batches(docs, summarised, window, gram, batches, hot)


def query(spark, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, s, w[s + 1 : s + 20] AS v FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 19, 0))) AS s FROM words)
), judged AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY v ORDER BY doc_id, s) > 1 AS dup FROM windows
), gone AS (
  SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS i FROM judged WHERE dup
), each AS (
  SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM words
), kept AS (
  SELECT e.doc_id, string_agg(e.w[e.i + 1], ' ' ORDER BY e.i) AS t, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
