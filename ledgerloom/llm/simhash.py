"""SimHash near-dedup: 64-bit fingerprints, BK-trees per shard, connected components.

Distinct fingerprints are sharded so that any two within the radius meet in a shard: of radius + 2
bands of their bits at least two agree, and each pair of bands (of some 21 bits) makes a shard, which
so stays small to a billion fingerprints. Each shard's fingerprints form a BK-tree (children keyed by
their integer Hamming distance to the parent), and its fingerprints follow only the edges whose
distance is within the radius of their own to the node. A tree goes to the tasks whose fingerprints
can reach it, not to every task. Crowded shards are split into several small trees, each of which all
of the shard's fingerprints search, in blocks. A shard gives no pairs, but for each of its components
one edge a member; components over all shards follow from these by alternating stars.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_steps, staged, table

RADIUS = 4
SHINGLE = 4
SEED = 42
#: A crowded shard's trees and the blocks of fingerprints that search each.
TREE = 512
BLOCK = 1024
#: Fingerprints that one group of shards holds, about.
GROUP = 20_000


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's shingles, unsigned; 0 if it has no word."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(words, len(found))
    n = len(found) - k + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    return majority(np.array([digest(joined[a:b], seed) for a, b in spans], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, unsigned; 0 of none."""
    h, counts = hashes.astype("<u8", copy=False), np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp = np.array([fingerprint(t, words, seed) for t in rows["text"]], np.uint64).view(np.int64)
        return pd.DataFrame({"doc_id": rows["doc_id"], "fp": fp})

    found = by_steps(docs.select(F.col("doc_id").cast("string"), "text"), run, "doc_id string, fp long")
    return found.select(F.col("doc_id").cast("long"), "fp")


def bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 bands of the 64 bits."""
    edges = np.linspace(0, 64, radius + 3).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:], strict=False)]


def shard_keys(fp: str, radius: int) -> list[Column]:
    """A long for each pair of bands: two fingerprints within the radius agree in both bands of one pair at least."""
    pick = lambda a, w: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1))
    pairs = list(itertools.combinations(bands(radius), 2))
    return [(F.shiftleft(pick(a, v), w) + pick(b, w)) * len(pairs) + i for i, ((a, v), (b, w)) in enumerate(pairs)]


class BKForest:
    """BK-trees of many shards, built and searched level by level with arrays."""

    def __init__(self, codes: np.ndarray, shard: np.ndarray):
        """codes: uint64; shard: which tree each belongs to, as 0..n-1 with none empty."""
        n = len(codes)
        self.codes, self.edge = codes, np.full(n, -1, np.int64)
        parent = np.full(n, -1, np.int64)
        order = np.argsort(shard, kind="stable")
        waiting, group = order, shard[order]
        self.roots = np.zeros(0, np.int64)
        while len(waiting):
            lead = np.concatenate([[True], group[1:] != group[:-1]])
            nodes = waiting[lead]
            if not len(self.roots):
                self.roots = nodes
            of = np.cumsum(lead) - 1
            rest = ~lead
            waiting, of = waiting[rest], of[rest]
            d = np.bitwise_count(codes[waiting] ^ codes[nodes[of]]).astype(np.int64)
            parent[waiting], self.edge[waiting] = nodes[of], d  # stays that of the last level, the parent's
            group = of * 65 + d
            order = np.argsort(group, kind="stable")
            waiting, group = waiting[order], group[order]
        inner = np.flatnonzero(parent >= 0)
        self.children = inner[np.argsort(parent[inner], kind="stable")]
        count = np.bincount(parent[inner], minlength=n)
        self.first = np.concatenate([[0], np.cumsum(count)])

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, in batches."""
        stack = [(np.arange(len(queries))[i : i + step], self.roots[shard[i : i + step]]) for i in range(0, len(queries), step)]
        while stack:
            q, node = stack.pop()
            d = np.bitwise_count(queries[q] ^ self.codes[node]).astype(np.int64)
            if (near := d <= radius).any():
                yield q[near], node[near]
            count = self.first[node + 1] - self.first[node]
            if not (total := int(count.sum())):
                continue
            at = np.repeat(self.first[node] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
            child = self.children[at]
            keep = np.abs(self.edge[child] - np.repeat(d, count)) <= radius
            q, child = np.repeat(q, count)[keep], child[keep]
            stack += [(q[i : i + step], child[i : i + step]) for i in range(0, len(q), step)]


def _least(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining a[i] and b[i] for all i: each the least position of its component."""
    while True:
        la, lb = labels[a], labels[b]
        low = np.minimum(la, lb)
        new = labels.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _shard_edges(codes: np.ndarray, shard: np.ndarray, member: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One edge (code, least code of its component) for each code with a link; members make the trees."""
    _, shard = np.unique(shard, return_inverse=True)
    inside = np.flatnonzero(member)
    if not len(inside):
        return codes[:0], codes[:0]
    own, tree = np.unique(shard[inside], return_inverse=True)
    forest = BKForest(codes[inside], tree)
    place = np.searchsorted(own, shard)
    ask = np.flatnonzero((place < len(own)) & (own[np.minimum(place, len(own) - 1)] == shard))
    labels = np.arange(len(codes))
    for q, node in forest.search(codes[ask], place[ask], radius):
        a, b = ask[q], inside[node]
        if (apart := codes[a] != codes[b]).any():
            labels = _least(labels, a[apart], b[apart])
    linked = np.flatnonzero(labels != np.arange(len(codes)))
    return codes[linked], codes[labels[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v), u > v, that connect exactly the fingerprints (fp) that links within the radius connect."""
    rows = staged(distinct.select("fp", F.explode(F.array(*shard_keys("fp", radius))).alias("shard")), "shards")
    crowded = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > block)
    crowded = staged(crowded.select(F.col("shard").alias("c"), F.ceil(F.col("n") / tree).alias("trees"), F.ceil(F.col("n") / block).alias("blocks")), "crowded")
    groups = max(1, rows.count() // GROUP)
    plain = rows.join(crowded, rows.shard == crowded.c, "left_anti").select("fp", "shard", F.pmod(F.xxhash64("shard"), F.lit(groups).cast("long")).alias("g"), F.lit(True).alias("member"))
    split = rows.join(crowded, rows.shard == crowded.c)
    mine, block_of = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("trees")), F.pmod(F.xxhash64("fp", F.lit(2)), F.col("blocks"))
    # a member goes to all blocks of its tree, with the flag; a query to its block of all other trees
    to = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(mine.alias("t"), b.cast("long").alias("b"), F.lit(True).alias("member"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("trees") - 1), lambda t: t != mine), lambda t: F.struct(t.cast("long").alias("t"), block_of.alias("b"), F.lit(False).alias("member"))),
    )
    split = split.select("fp", "shard", F.explode(to).alias("x"))
    place = F.xxhash64("shard", "x.t", "x.b")
    split = split.select("fp", place.alias("shard"), place.alias("g"), F.col("x.member").alias("member"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        codes = frame["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((codes, frame["shard"].to_numpy()))
        u, v = _shard_edges(codes[order], frame["shard"].to_numpy()[order], frame["member"].to_numpy()[order], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    found = plain.unionByName(split).groupBy("g").applyInPandas(run, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the least node of its component.

    Alternating large and small stars: each round hangs the larger neighbours of a node, then the
    smaller ones, on the least; a node with many neighbours is a key of many rows, never one row.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(least, large.u == least.k)
        small = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = staged(small.where("u <> v").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row of docs.

    Null and wordless texts have fingerprint 0 and link like any other. Rows may share a doc_id. Null
    ids stay and count as no one's smallest, so that a component of null ids alone has a null id.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = staged(fingerprints(docs, words, seed), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius)).select(F.col("node").alias("n"), "root")
    labelled = classes.join(roots, classes.fp == roots.n, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = staged(labelled, "labelled")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = staged(labelled.join(smallest, "root").select(F.col("fp").alias("f"), "component_id"), "components")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of, rows.fp == of.f).select("doc_id", text.alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
