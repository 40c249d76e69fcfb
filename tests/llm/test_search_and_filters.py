"""Vector searches, URL filter, mix and packing against brute force."""

import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, neighbours, packing, topk, urls
from ledgerloom.llm.common import fold

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def vectors(n=400, d=12, seed=0, same=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.2, 3, size=(n, 1))
    x[:same] = x[0]
    rows = [(i, x[i].astype(np.float32).tolist(), 1, 0.0) for i in range(n)]
    return rows + [(n, None, 1, 0.0), (n + 1, [0.0] * d, 1, 0.0), (n + 2, [float("nan")] * d, 1, 0.0), (n + 3, [1.0, None] + [0.0] * (d - 2), 1, 0.0), (n + 4, [1.0], 1, 0.0), (None, [1.0] * d, 1, 0.0)]


def brute(x, ids, k, modulus):
    out = {}
    for q in range(len(ids)):
        if ids[q] % modulus == 0:
            s = (x * x[q]).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
            out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def grouped(df):
    found = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    return found


def test_top_k_is_exact(spark):
    rows = vectors()
    ids = np.array([r[0] for r in rows[:400]] + [401])
    x = np.floor(np.array([r[1] for r in rows[:400]] + [[0.0] * 12]) * 1024)
    got = grouped(topk.search(spark.createDataFrame(rows, VECTORS), modulus=20))
    assert got == {q: [(i, int(s)) for i, s in best] for q, best in brute(x, ids, 10, 20).items()}


def test_stripes_prune_nothing_that_counts():
    rng = np.random.default_rng(3)
    v, q = np.floor(rng.normal(size=(500, 8)) * 500), np.floor(rng.normal(size=(20, 8)) * 500)
    _, turn = np.linalg.eigh(v.T @ v)
    i, j, s = topk.stripe_search(q, v, turn[:, ::-1], np.full(20, -np.inf), 5, stripe=64)
    for n in range(20):
        exact = sorted((q[n] @ v.T).tolist(), reverse=True)[:5]
        assert sorted(s[i == n].tolist(), reverse=True)[:5] == exact


def test_huge_integers_are_exact():
    q, v = np.array([[2.0**30, 1.0]]), np.array([[2.0**31, 1.0]])
    assert topk.exact_products(q, v)[0] == 2**61 + 1


def test_neighbours_find_most_and_rank_ties_by_id(spark):
    rows = vectors(n=3000, d=16, seed=5)
    ids = np.array([r[0] for r in rows[:3000]])
    x = np.array([r[1] for r in rows[:3000]], np.float32).astype(float)
    got, want = grouped(neighbours.search(spark.createDataFrame(rows, VECTORS))), brute(x, ids, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for best in got.values():  # by score, ties by id
        assert best == sorted(best, key=lambda x: (-x[1], x[0]))
    same = [i for i, s in got[0] if abs(s - (x[0] * x[0]).sum()) < 1e-12]
    assert same == sorted(same)


@pytest.mark.parametrize("search", [topk.search, neighbours.search])
def test_no_vector_and_few_vectors(spark, search):
    assert search(spark.createDataFrame([], VECTORS)).count() == 0
    few = [(0, [1.0, 0.0], 1, 0.0), (1, [0.5, 1.0], 1, 0.0), (2, [2.0, 0.0], 1, 0.0)]
    got = grouped(search(spark.createDataFrame(few, VECTORS), modulus=100))
    assert [i for i, _ in got[0]] == [2, 1]


PAGES = "page_id long, url string, html string, key string"


def judged(spark, urls_, **options):
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls_)], PAGES)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"max_bits": 1}])
def test_urls(spark, options):
    cases = [
        ("https://A.example.COM/en/7?x#y", ("a.example.com", "/en/7", "example.com/en/7", "allow")), ("http://example.com/en/8", ("example.com", "/en/8", "com/en/", "block")),
        ("http://b.example.net/de/81", ("b.example.net", "/de/81", "example.net/de/8", "block")), ("http://example.net/de/9", ("example.net", "/de/9", "net/de/", "allow")),
        ("http://xcom/en/", ("xcom", "/en/", None, "allow")), ("http://com/en/", ("com", "/en/", "com/en/", "block")), ("http://example.org/es", ("example.org", "/es", None, "allow")),
        ("ftp://org/es/#z", ("org", "/es/", "org/es/", "block")), ("com/en/", ("", "", None, "allow")), (None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("://", ("", "", None, "allow")),
        ("http://example.com", ("example.com", "", None, "allow")), ("http://example.com?/en/7", ("example.com", "", None, "allow")), ("http://a://b/en/", ("a:", "//b/en/", None, "allow")),
    ] * 2
    assert judged(spark, [u for u, _ in cases], **options) == {i: want for i, (_, want) in enumerate(cases)}
    listed = spark.createDataFrame([(r, a) for a, r in urls.RULES], "key string, action string")
    assert judged(spark, [u for u, _ in cases[:8]], rules=listed, **options) == {i: want for i, (_, want) in enumerate(cases[:8])}


def test_cascade_is_exact(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 600, 3)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    cascade = urls.Cascade.fit(listed, universe)
    assert len(cascade.levels) > 1
    got = {r["key"] for r in universe.where(cascade.lists(universe.key)).collect()}
    assert got == {f"k{i}" for i in range(0, 600, 3)}
    assert judged(spark, []) == {} and judged(spark, ["http://a.com/en/"], rules=()) == {0: ("a.com", "/en/", None, "allow")}


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, id_ string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "z", "z") for i, t, s in rows], DOCS)


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["a", "b", "c", None][min(3, int(rng.exponential(1)))]) for i in range(900)] + [(900, None, "a"), (901, "", "empty"), (902, "x", None), (902, "x", None)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:  # by rounds: share, cap, share the rest again
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2 * size[s]
        left, open_ = left - sum(target[s] for s in over), open_ - set(over)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 150
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()), key=repr)
    out = mixing.mix_documents(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_rows_without_id_are_mixed_by_their_texts(spark):
    """Two thirds of the rows have neither id nor source: the SQL agrees, reruns agree on which texts are taken, and
    a cap of one and a half gives some documents two copies."""
    rows = [(None, f"w{i} " * (i % 7 + 1), None) for i in range(600)] + [(i, f"x{i} y", "web") for i in range(300)]
    table = docs(spark, rows).select("doc_id", "text", "source")
    mixed = mixing._mixed(table)
    assert mixed.where("doc_id IS NULL").select("without_id").distinct().count() == 600 and mixed.count() == 900
    con = duckdb.connect()
    con.register("documents", table.toArrow())
    want = con.execute(mixing.ORACLE).fetchall()
    got = [tuple(r) for r in mixing.mix(table).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    out = mixing.mix_documents(table)
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert sorted(map(repr, out.collect())) == sorted(map(repr, mixing.mix_documents(table.repartition(5)).collect()))
    half = mixing.mix(table, share=10.0, cap=1.5).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"))
    for r in half.collect():
        assert r["most"] == 2 and abs(r["taken"] - r["target"]) <= 30


TOKENIZER = None
try:
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
except ImportError:
    pass
needs_tokenizer = pytest.mark.skipif(TOKENIZER is None, reason="no tokenizer files")


@needs_tokenizer
def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(TOKENIZER), packing.Ids(TOKENIZER, cached=6)
    texts = ["", " ", "a  b", "a\tb c", "\n\nx y", "x\n\ny", "x \ny", "é,! ab.\nC'est l'an don't 12,3.4!!", "a b ", "x\n", "<|endoftext|> a", "it's, a,", "\n", "w,'s a", "ok\x1cb c", "a1, b2. 3%", "日本 語\u3000x", "one two three\nfour five, six. seven eight! nine"] * 2
    for t in texts:
        assert fast(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@needs_tokenizer
def test_packing_keeps_every_id_once(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(0, 900)))), "s") for i in range(120)] + [(500, None, "s"), (501, "", "s"), (None, "null id", "s"), (502, "x " * 6000, "s"), (503, "same", "s"), (503, "same", "s")]
    pieces = packing.pack(docs(spark, rows), TOKENIZER).collect()
    plain, of = Tokenizer.from_file(TOKENIZER), defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
    for i, t, _ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(of[i], key=lambda p: p["start"])
        if i == 503:
            assert sum(p["length"] for p in got) == 2 * len(ids)
            continue
        assert b"".join(p["ids"] for p in got) == ids.tobytes() and [p["start"] for p in got] == [0, *np.cumsum([p["length"] for p in got])[:-1]]
        assert all(p["doc_tokens"] == len(ids) for p in got)
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for w in windows.values():
        ends = 0
        for offset, length in sorted(w):
            assert offset == ends and length > 0
            ends += length
        assert ends == 1024 or ends & (ends - 1) == 0
    one = packing.digest(packing.pack(docs(spark, [(1, "a b c", "s")]), TOKENIZER)).first()
    assert one["ids_crc32"] == zlib.crc32(np.array([*plain.encode("a b c", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0


def squares_after(counts, window, size, level):
    """The sum of squared counts once `size` ids went to `level`: whole, or cut where they fill its window."""
    n = counts.copy()
    n[level] -= level > 0
    end = level + size
    n[end if end < window else end - window] += end != window
    return int((n[1:] ** 2).sum())


@pytest.mark.parametrize("new", [True, False])
def test_sum_of_squares_picks_the_least(new):
    rng = np.random.default_rng(4)
    p = packing.SumOfSquares(32, 10**6)
    for k in range(500):
        size = int(rng.integers(1, 32))
        open_levels = [int(x) for x in np.flatnonzero(p.counts)]
        opens = new or not p.held
        levels = [0, *[x for x in open_levels if x + size <= 32]] if opens else open_levels
        after = {x: squares_after(p.counts, 32, size, x) for x in levels}
        at = p.level(size, opens)
        least = [x for x in levels if after[x] == min(after.values())]
        whole = [x for x in least if x + size <= 32]
        assert at == max(whole or least)
        p.put([(k, 0, bytes(4 * size), size)], size, opens)
        assert int((p.counts[1:] ** 2).sum()) == after[at] and p.held == p.counts.sum()


@pytest.mark.parametrize("sizes", [[600] * 3000, [1023, 2] * 500, [1], [1023], [], [512] * 7, None])
def test_open_windows_are_bounded_and_filled_by_the_same_rule(sizes):
    """Also where no two documents fit together: no more than `most` windows are open, and in the end every window is full
    but for less than one, which is cut at powers of two."""
    if sizes is None:
        sizes = np.random.default_rng(5).integers(1, 1024, 4000).tolist()
    p, full = packing.SumOfSquares(1024, 50), []
    for k, size in enumerate(sizes):
        if done := p.put([(k, 0, k.to_bytes(4, "little") * size, size)], size):
            full.append(done)
        assert p.held <= 50
    ends = list(p.finish())
    lengths = [sum(len(x[2]) // 4 for x in w) for w in full + ends]
    short = [n for n in lengths if n < 1024]
    assert sum(lengths) == sum(sizes) and max(lengths, default=0) <= 1024 and sum(short) < 1024
    assert short == sorted(set(short), reverse=True) and all(n & (n - 1) == 0 for n in short)
    got = defaultdict(list)
    for doc, start, ids, _ in (x for w in full + ends for x in w):
        assert ids == doc.to_bytes(4, "little") * (len(ids) // 4)
        got[doc].append((start, len(ids) // 4))
    for k, size in enumerate(sizes):
        parts = sorted(got[k])
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) == size


@needs_tokenizer
def test_all_but_a_window_a_task_is_packed_by_sum_of_squares(spark):
    """Of the given documents less than a window for each task is in windows that aren't full, however small the tasks."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for tasks in (2, 8):
        rows = packing.digest(packing.pack(table.repartition(tasks), TOKENIZER)).groupBy("sequence_id").agg({"length": "sum"}).collect()
        short = [r[1] for r in rows if r[1] < 1024]
        assert sum(short) < 1024 * tasks and sum(short) < 0.05 * sum(r[1] for r in rows)


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "doc_id long")
    for r in rows.select("doc_id", fold(rows.doc_id).alias("f")).collect():
        assert r["f"] == (0 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5)


def test_the_ratio_alone_selects_lists():
    rng = np.random.default_rng(6)
    c, x = rng.normal(size=(500, 24)), 0.05 * rng.normal(size=(40, 24))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    graph = neighbours.Graph(c)
    row, at = graph.probes(x, 1.3, 8)
    into = np.zeros((40, 500), bool)
    into[row, at] = True
    dist = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (into == (dist <= 1.3 * np.sort(dist, axis=1)[:, 7:8])).mean() > 0.999
    assert into.sum(1).max() > 96
    sizes = rng.integers(0, 300, 500)
    sizes[7] = 5000
    group, parts = graph.groups(sizes, 1000)
    held = np.bincount(group, sizes)
    assert parts[7] == 5 and (parts[np.arange(500) != 7] == 1).all() and held[group[7]] == 5000 and (np.delete(held, group[7]) <= 1000).all()


def test_lists_are_balanced_and_replicated(spark):
    """One dense heap among vectors without clusters: its list is split."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 24))
    x[:800] = x[0] + 0.05 * rng.normal(size=(800, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    told = {}
    got = grouped(neighbours.search(spark.createDataFrame([(i, v.astype(np.float32).tolist(), 1, 0.0) for i, v in enumerate(x)], VECTORS), told=told))
    want = brute(x.astype(np.float32).astype(float), np.arange(4000), 20, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    assert told["greatest"] <= 2 * told["median"] + 1 and told["replicas"] > 1.3 and told["read"] < 0.7


def test_all_lists_in_the_ratio_are_searched(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_LIST", 10)
    rows = vectors(n=3000, d=16, seed=5)
    x = np.array([r[1] for r in rows[:3000]], np.float32).astype(float)
    got, want = grouped(neighbours.search(spark.createDataFrame(rows, VECTORS), modulus=100, prune=1e9)), brute(x, np.arange(3000), 20, 100)
    assert {q: {i for i, _ in best} for q, best in got.items()} == {q: {i for i, _ in best} for q, best in want.items()}
