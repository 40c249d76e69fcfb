"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted to a bounded sample by k-means that keeps clusters even, and linked to a graph of
their neighbours; every task holds both and searches them greedily with a beam. Each vector goes to
its nearest list, and a boundary vector also to further lists about as near. Lists that turn out more
than twice as long as the median are split by k-means of their own, so that all are of like length. A
query takes every list whose distance is within a ratio of the nearest ones', however many; the ratio
is taken to the BASE-th nearest, as a stored vector has drawn the few nearest to itself.
Neighbouring lists are grouped, so that a query is sent once to a group and not once to each list.
Groups and queries meet in blocks of bounded size, whose products are exact; the best per query are merged.
Inner products are searched as distances after adding one component that evens out the lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import LARGEST, answers, best_lists, classes, norm, queries_of, usable

#: Bounds of the index: vectors that it is fitted to (and that a split looks at), vectors of a list before
#: replicas, lists before splits (a fifth of the sample), lists a vector may be in.
SAMPLE = 40_000
PER_LIST = 12
REPLICAS = 4
DEGREE = 24
#: Squared distances are compared: a boundary vector's further lists to its nearest, a query's lists to its BASE-th.
BOUNDARY = 1.3
PRUNE = 1.35
BASE = 8
#: Rounds in which lists of more than UNEVEN times the median are split; the last deals them out by hash.
UNEVEN = 2
ROUNDS = 5
#: Vectors of a group of lists and queries that meet them at once, at most.
GROUP = 4096
BLOCK = 1024
#: Rows that a task holds before it passes them on.
STEP = 1024


class Graph:
    """Centroids and the graph of their nearest neighbours."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.centroids = c = centroids.astype(np.float32)
        self.squares = (c * c).sum(1)
        k = min(degree, len(c) - 1)
        near = np.zeros((len(c), k), np.int64)
        for i in range(0, len(c), 512):
            d = self.squares[None, :] - 2 * c[i : i + 512] @ c.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
        rng = np.random.default_rng(0)
        far = rng.integers(0, len(c), (len(c), min(8, max(len(c) - 1, 0))))  # long edges, so that no part is cut off
        self.links = np.concatenate([near, far], axis=1)
        self.entries = np.unique(rng.choice(len(c), min(32, len(c)), replace=False))

    def _distances(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (x * x).sum(1)[:, None] + self.squares[at] - 2 * np.einsum("qd,qnd->qn", x, self.centroids[at])

    def nearest(self, x: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, squared distances) of up to k centroids for each row of x, nearest first; -1 pads.

        A best-first search with a beam: in each round every row opens its nearest unopened centroids.
        """
        x, n = x.astype(np.float32), len(self.centroids)
        beam = min(max(beam, k), n)
        rows = np.arange(len(x))[:, None]
        seen, opened = np.zeros((len(x), n + 1), bool), np.zeros((len(x), n + 1), bool)
        held = np.tile(self.entries[:beam], (len(x), 1))
        dist = self._distances(x, held)
        seen[rows, held] = True
        opened[:, n] = True
        while True:
            fresh = np.where(opened[rows, held], np.inf, dist)
            pick = np.argsort(fresh, axis=1, kind="stable")[:, : max(4, beam // 16)]
            go = np.take_along_axis(held, pick, 1)
            live = np.isfinite(np.take_along_axis(fresh, pick, 1))
            if not live.any():
                break
            opened[rows, np.where(live, go, n)] = True
            new = self.links[np.where(live, go, 0)]
            new = np.where(live[:, :, None], new, n).reshape(len(x), -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            new = np.where(seen[rows, new], n, new)
            seen[rows, new] = True
            d = self._distances(x, np.minimum(new, n - 1))
            d[new == n] = np.inf
            held, dist = np.concatenate([held, new], 1), np.concatenate([dist, d], 1)
            top = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            held, dist = np.take_along_axis(held, top, 1), np.take_along_axis(dist, top, 1)
            held = np.where(np.isfinite(dist), held, n)
        held, dist = held[:, :k], np.maximum(dist[:, :k], 0)
        return np.where(held == n, -1, held), dist

    def lists(self, x: np.ndarray, replicas: int = REPLICAS, ratio: float = BOUNDARY) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each vector belongs to."""
        near, dist = self.nearest(x, replicas, beam=max(32, 4 * replicas))
        taken = (near >= 0) & (dist <= ratio * dist[:, :1] + 1e-12)
        taken[:, 0] = True
        row, j = np.nonzero(taken)
        return row, near[row, j]

    def probes(self, x: np.ndarray, ratio: float = PRUNE, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists within the ratio of the base-th nearest's distance: the beam grows until it holds
        one beyond."""
        found, waiting, beam = [], np.arange(len(x)), 64
        while len(waiting):
            near, dist = self.nearest(x[waiting], beam, beam)
            most = ratio * dist[:, min(base, dist.shape[1]) - 1] + 1e-12
            done = (dist[:, -1] > most) | (near.shape[1] >= len(self.centroids))
            row, j = np.nonzero(((near >= 0) & (dist <= most[:, None]))[done])
            found.append((waiting[done][row], near[done][row, j]))
            waiting, beam = waiting[~done], beam * 4
        row, at = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(row, kind="stable")
        return row[order], at[order]

    def groups(self, sizes: np.ndarray, most: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
        """(group, parts) of each list: neighbouring lists that hold at most `most` vectors together, or one
        larger list in parts."""
        group, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
        at, held = 0, 0
        for i in self._along().tolist():
            if held and held + sizes[i] > most:
                at, held = at + 1, 0
            group[i], held = at, held + sizes[i]
        return group, parts

    def _along(self) -> np.ndarray:
        """The lists in an order that keeps neighbours together: halved again and again along the widest direction."""
        waiting, out = [np.arange(len(self.centroids))], []
        while waiting:
            part = waiting.pop()
            if len(part) <= 4:
                out.append(part)
                continue
            x = self.centroids[part].astype(np.float64)
            x -= x.mean(0)
            part = part[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
            waiting += [part[len(part) // 2 :], part[: len(part) // 2]]
        return np.concatenate(out)


def row_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise inner products in doubles, the same sum wherever a vector stands; infinite beyond them."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (q * v).sum(1)
        bad = ~np.isfinite(out)
        if bad.any():
            m, n = np.abs(q[bad]).max(axis=1), np.abs(v[bad]).max(axis=1)
            out[bad] = (q[bad] / m[:, None] * (v[bad] / n[:, None])).sum(1) * m * n
    return out


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of unit vectors whose assignment pays for a cluster's size, so that no list grows far beyond the rest."""
    rng = np.random.default_rng(0)
    x = x.astype(np.float32)
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    price = np.zeros(k, np.float32)
    for _ in range(rounds):
        own = np.concatenate([(price - 2 * x[i : i + 2048] @ c.T).argmin(1) for i in range(0, len(x), 2048)])
        size = np.bincount(own, minlength=k)
        total = np.zeros((k, x.shape[1]))
        np.add.at(total, own, x)
        if (size == 0).any():
            total[size == 0] = x[rng.choice(len(x), int((size == 0).sum()))]
        c = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        spread = float(np.mean((x - c[own]) ** 2) * x.shape[1])
        price = (0.3 * spread * (size / size.mean() - 1)).astype(np.float32).clip(-spread, spread)
    return c


class Lists:
    """The index of distinct vectors (rep, v): posted (list, rep, v), the graph of the lists' centroids, their sizes."""

    def __init__(self, reps: DataFrame, n: int, longest: float):
        self.spark, self.longest = reps.sparkSession, longest
        rate = min(1.0, SAMPLE / n)
        picked = reps.where(F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1 << 30).cast("long")) < int(rate * (1 << 30)) + (rate >= 1)).orderBy("rep").limit(2 * SAMPLE)
        sample = self.even(np.array([r["v"] for r in picked.select("v").toLocalIterator()]))
        centroids = balanced_centroids(sample, int(max(1, min(n // PER_LIST, len(sample) // 5))))
        sent, even = self.spark.sparkContext.broadcast(Graph(centroids)), self.even  # SAMPLE / 5 centroids at most

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), STEP):
                    part = batch.iloc[i : i + STEP]
                    row, at = sent.value.lists(even(np.stack(part["v"].to_numpy())))
                    yield pd.DataFrame({"list": at, "rep": part["rep"].to_numpy()[row], "v": part["v"].to_numpy()[row]})

        self.posted = staged(reps.select("rep", "v").mapInPandas(place, "list long, rep long, v array<double>"), "lists")
        for round_ in range(ROUNDS):
            self.sizes = self._counted(len(centroids))
            limit = UNEVEN * float(np.median(self.sizes[self.sizes > 0]))
            over = np.flatnonzero(self.sizes > limit)
            if not len(over):
                break
            centroids = self._split(centroids, over, limit / UNEVEN, round_ == ROUNDS - 1)
        self.sizes = self._counted(len(centroids))
        self.graph = Graph(centroids)

    @property
    def even(self):
        longest = self.longest

        def even(x: np.ndarray, query: bool = False) -> np.ndarray:
            """Scaled by the longest vector, with the component that gives all vectors its length."""
            if query:  # a query's own length doesn't change its order
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            else:
                x = x / longest
            rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
            return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)

        return even

    def _counted(self, lists: int) -> np.ndarray:
        sizes = np.zeros(lists, np.int64)
        for r in self.posted.groupBy("list").count().toLocalIterator():  # a row for each list
            sizes[r["list"]] = r["count"]
        return sizes

    def _split(self, centroids: np.ndarray, over: np.ndarray, size: float, by_hash: bool) -> np.ndarray:
        """Lists longer than UNEVEN medians dealt to as many as they have sizes; gives all centroids."""
        even, pieces = self.even, np.ceil(self.sizes[over] / size).astype(int)
        where = self.spark.createDataFrame([(int(x),) for x in over], "list long")
        rate = min(1.0, SAMPLE / self.sizes[over].sum())
        chance = F.pmod(F.xxhash64("rep", "list"), F.lit(1 << 30).cast("long")) <= int(rate * (1 << 30))
        rows = self.posted.join(F.broadcast(where), "list").where(chance).select("list", "rep", "v").orderBy("list", "rep").limit(2 * SAMPLE)
        rows = [] if by_hash else rows.toLocalIterator()
        members: dict[int, list] = {}
        for r in rows:
            members.setdefault(r["list"], []).append(r["v"])
        children, first = {}, len(centroids)
        for at, k in zip(over.tolist(), pieces.tolist(), strict=True):
            own = even(np.array(members[at])) if len(members.get(at, ())) >= 2 * k else None
            c = np.repeat(centroids[at : at + 1], k, axis=0) if own is None else balanced_centroids(own, k)
            children[at] = (np.concatenate([[at], np.arange(first, first + k - 1)]), c, own is None)
            first += k - 1
        out = np.zeros((first, centroids.shape[1]), np.float32)
        out[: len(centroids)] = centroids
        for at, c, _ in children.values():
            out[at] = c
        sent = self.spark.sparkContext.broadcast(children)

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                at = batch["list"].to_numpy().copy()
                for old in np.intersect1d(at, np.array(list(sent.value), np.int64)).tolist():
                    new, c, hashed = sent.value[old]
                    rows = np.flatnonzero(batch["list"].to_numpy() == old)
                    own = batch["rep"].to_numpy()[rows] % len(new) if hashed else (even(np.stack(batch["v"].to_numpy()[rows])) @ c.T).argmax(1)
                    at[rows] = new[own]
                yield batch.assign(list=at)

        self.posted = staged(self.posted.mapInPandas(deal, "list long, rep long, v array<double>"), "lists")
        return out

    def figures(self, share_read: float) -> dict[str, float]:
        """What tells whether the lists are balanced, replicate boundary vectors and are pruned."""
        held = self.sizes[self.sizes > 0]
        reps = self.posted.select("rep").distinct().count()
        return {"lists": len(held), "greatest": int(held.max()), "median": float(np.median(held)), "replicas": held.sum() / reps, "read": share_read}


def search(vectors: DataFrame, k: int = 20, modulus: int = 20, prune: float = PRUNE, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by modulus the k others with
    the largest inner products found; ties go to the smaller id.

    Null, zero and ragged vectors, those with null or non-finite components and null ids take no part;
    a query of fewer others gets them all. Equal vectors are searched once; an id counts once, with
    the least of its vectors. An empty table gives no row. A product beyond doubles is infinite.

    told: gets the figures of the lists, and what share of the stored rows a query reads (told["read"]).
    """
    spark = vectors.sparkSession
    rows = usable(vectors, nonzero=True)
    reps = classes(rows, k + 1)
    asked = queries_of(rows, reps, modulus)
    n, longest = reps.agg(F.count("*"), F.max(norm(F.col("v")))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Lists(reps, n, longest)
    posted, sizes, even, count = index.posted, index.sizes, index.even, len(index.sizes)
    sent = spark.sparkContext.broadcast(index.graph)
    group, parts = index.graph.groups(sizes)
    held = spark.sparkContext.broadcast(group)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = held.value
        for batch in batches:
            for i in range(0, len(batch), STEP):
                part = batch.iloc[i : i + STEP]
                row, at = sent.value.probes(even(np.stack(part["v"].to_numpy()), True), prune)
                order = np.lexsort((at, of[at], row))
                row, at = row[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (of[at][1:] != of[at][:-1])]))
                lists = np.split(at, first[1:])
                for j in range(0, len(first), STEP):
                    f = first[j : j + STEP]
                    yield pd.DataFrame({"g": of[at[f]], "rep": part["rep"].to_numpy()[row[f]], "v": part["v"].to_numpy()[row[f]], "lists": lists[j : j + STEP]})

    asking = asked.select("rep").distinct().join(reps.select("rep", "v"), "rep")
    asking = staged(asking.select("rep", "v").mapInPandas(ask, "g long, rep long, v array<double>, lists array<long>"), "probes")
    if told is not None:
        length = spark.createDataFrame(pd.DataFrame({"l": np.arange(count), "size": sizes}))
        read = asking.select("rep", F.explode("lists").alias("l")).join(F.broadcast(length), "l").groupBy("rep").agg(F.sum("size").alias("x")).agg(F.avg("x")).first()[0]
        told |= index.figures((read or 0) / sizes.sum())
    # blocks: parts of a group's vectors by queries that look into it, each of bounded size
    of_list = spark.createDataFrame(pd.DataFrame({"list": np.arange(count), "g": group, "a": parts}))  # a row for each list
    blocks = of_list.groupBy("g").agg(F.max("a").alias("a")).join(asking.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("b")), "g")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = posted.join(F.broadcast(of_list.select("list", "g")), "list").join(F.broadcast(blocks), "g").select("g", deal("a").alias("i"), every("b").alias("j"), "list", "rep", "v")
    right = asking.join(F.broadcast(blocks), "g").select("g", every("a").alias("i"), deal("b").alias("j"), "lists", "rep", "v")

    schema = "rep long, best array<struct<n:double,near:long>>"

    def meet(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "best": []})
        near, first, column = np.unique(members["rep"].to_numpy(), return_index=True, return_inverse=True)
        v, q = np.stack(members["v"].to_numpy()[first]), np.stack(queries["v"].to_numpy())
        asker = np.repeat(np.arange(len(q)), queries["lists"].map(len))
        wanted = np.concatenate(queries["lists"].to_list())
        products = np.full((len(q), len(v)), -np.inf)
        large = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] > LARGEST / 4  # order by scaled products then
        q_, v_ = (q / np.abs(q).max(axis=1, keepdims=True), v / np.abs(v).max()) if large else (q, v)
        for at in np.unique(members["list"]):
            rows, columns = asker[wanted == at], column[(members["list"] == at).to_numpy()]
            products[rows[:, None], columns[None, :]] = q_[rows] @ v_[columns].T
        most = min(k + 4, len(v))
        top = np.argpartition(-products, most - 1, axis=1)[:, :most]
        i, j = np.repeat(np.arange(len(q)), most), top.ravel()
        seen = products[i, j] > -np.inf
        i, j = i[seen], j[seen]
        exact = row_products(q[i], v[j])
        best = best_lists(i, near[j], exact, k + 1)
        return pd.DataFrame({"rep": queries["rep"].to_numpy(), "best": best + [[]] * (len(q) - len(best))})

    key = ["g", "i", "j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, schema)
    return answers(asked, found, reps, k, REPLICAS)


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
