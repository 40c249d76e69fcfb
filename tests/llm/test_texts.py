"""Near-duplicates, repeated passages, classifiers and the pipeline against brute force."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import language, mixing, quality, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string"
SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "z", "z") for i, t in rows], DOCS)


def mutated(rng, words, n):
    out = list(words)
    for i in rng.integers(0, len(out), n):
        out[i] = f"new{rng.integers(0, 10**6)}"
    return out


def corpus(seed=0, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 6))))
    base = [[word() for _ in range(int(rng.integers(1, 200)))] for _ in range(n)]
    passage = [word() for _ in range(55)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(base[i])) for i in range(0, n, 4)] + [(200 + i, "\n".join(mutated(rng, base[i], 1))) for i in range(0, n, 3)]
    rows += [(300 + i, " ".join(base[i][: len(base[i]) // 2] + passage + base[i][len(base[i]) // 2 :])) for i in range(0, n, 5)]
    rows += [(400, None), (401, ""), (402, " \t"), (403, " ".join(passage + passage)), (None, rows[1][1]), (404, "x"), (404, "x"), (405, "Word " * 3000)]
    return rows


def fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint_by_hand():
    for _, text in corpus():
        assert simhash.fingerprint(text) == fingerprint(text)


@pytest.mark.parametrize(("tree", "block"), [(512, 1024), (7, 11)])
def test_components(spark, tree, block, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, tree, block))
    rng = np.random.default_rng(1)
    rows = corpus()
    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    want = Counter((doc, f"{prints[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(rows))
    assert Counter(map(tuple, simhash.near_duplicates(docs(spark, rows)).collect())) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    del rng


def test_bk_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**62, 300, dtype=np.uint64) & np.uint64(0xFFF)
    shard = np.sort(rng.integers(0, 4, 300))
    forest = simhash.BKForest(codes, shard)
    got = set()
    for q, n in forest.search(codes, shard, 3, step=50):
        got |= set(zip(q.tolist(), n.tolist(), strict=True))
    assert got == {(i, j) for i in range(300) for j in range(300) if shard[i] == shard[j] and int(codes[i] ^ codes[j]).bit_count() <= 3}


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {got[i] for i in range(1, 201)} == {0} and {got[i] for i in range(1001, 1100)} == {1000}


def brute_substring(rows):
    key = lambda i: (1 << 63) - 1 if i is None else i
    words = [(key(i), (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (doc, _), (i, w) in zip(rows, words, strict=True):
        gone = {x for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (i, s) for x in range(s, s + 20)}
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"hot": 1, "batches": 3}, {"batches": 1}])
def test_repeats(spark, options):
    rows = corpus(3)
    assert Counter(map(tuple, substring.summary(docs(spark, rows), **options).collect())) == brute_substring(rows)
    assert substring.summary(docs(spark, [])).count() == 0


@pytest.mark.parametrize("heavy", [False, True])
def test_an_index_takes_batches_over_sessions(spark, tmp_path, monkeypatch, heavy):
    """Three batches, the index closed and opened again in between, give what one table gives; runs are compacted.
    heavy: every anchor that a batch repeats is spread over the buckets."""
    if heavy:
        for name, value in (("SAMPLED", 1), ("LEAST", 1), ("HEAVY", 10**6)):
            monkeypatch.setattr(substring, name, value)
    rows = [(i, t) for i, t in corpus(5) if i is not None]
    rows = sorted(rows, key=lambda r: r[0])
    want = brute_substring(rows)
    at, got = str(tmp_path / "index"), Counter()
    index = substring.FingerprintIndex.create(spark, at, buckets=4)
    for k, low in enumerate((0, 100, 250)):
        part = [r for r in rows if low <= r[0] < (100, 250, 10**9)[k]]
        got += Counter(map(tuple, substring.summarised(index, docs(spark, part)).collect()))
        index.close()
        index = substring.FingerprintIndex.open(spark.newSession(), at)
        assert len(index.runs) == k + 1 and (index.runs[-1]["heavy"] > 0) == (heavy and k != 0)
    assert got == want
    assert not index.compact(fanout=4) and len(index.runs) == 3
    before = sum(r["rows"] for r in index.runs)
    assert index.compact(fanout=3) and not index.compact(fanout=3)
    assert len(index.runs) == 1 and sum(r["rows"] for r in index.runs) == before
    index.close()
    index = substring.FingerprintIndex.open(spark, at)
    again = substring.added(index, docs(spark, [(10**6 + i, t) for i, t in rows] + [(3, "all new words here")])).collect()
    assert all(not r["text"] for r in again if len((dict(rows).get(r["doc_id"] - 10**6) or "").split()) >= 20)
    assert [r["text"] for r in again if r["doc_id"] == 3] == ["all new words here"] and len(again) == len(rows) + 1


def test_texts_of_like_digests_are_told_apart(spark):
    """Two texts whose SHA-256 begin alike, and whose shared passage stands at the same place."""
    base, seen, n = " ".join(f"alpha{i}" for i in range(20)), {}, 0
    while True:
        text = f"{base} tail{n}"
        start = hashlib.sha256(text.encode()).hexdigest()[:8]
        if start in seen:
            break
        seen[start], n = text, n + 1
    rows = [(1, seen[start]), (2, text)]
    assert Counter(map(tuple, substring.summary(docs(spark, rows)).collect())) == brute_substring(rows)
    assert brute_substring(rows)[(2, 21, 20, hashlib.sha256(f"tail{n}".encode()).hexdigest())] == 1


def test_dedup_keeps_rows_and_columns(spark):
    rows = corpus(4)
    out = substring.dedup(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns and out.count() == len(rows)
    text = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (400, None) in text and (402, " \t") in text and (0, rows[0][1]) in text
    assert all(not t for i, t in text if i is not None and 100 <= i < 200 and len(dict(rows)[i].split()) >= 20)


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@needs_tables
def test_language_accuracy_and_edges(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(d)
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i][0] == truth[i] for i in held) / len(held) > 0.98
    odd = docs(spark, [(1, None), (2, ""), (3, "123 !!"), (None, "the of and"), (5, "the and of with " * 20000)])
    found = [(r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()]
    assert [p for p, _ in found[:3]] == ["und"] * 3 and all(0 <= s <= 1 for _, s in found)
    assert language.train(docs(spark, [])) is None and [r["lang_pred"] for r in language.identify(odd, None).collect()] == ["und"] * 5


@needs_tables
@pytest.mark.parametrize(("module", "label", "limit", "least"), [(toxicity, "toxic", 0.5, 0.9), (quality, "quality", quality.THRESHOLD, 0.95)])
def test_classifiers_rank_held_out_rows(spark, module, label, limit, least):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = module.train(d, labels)
    odd = docs(spark, [(1, None), (2, ""), (None, "a b"), (3, "word " * 30000), (3, "word " * 30000)])
    score = (lambda x: module.classify(x, model)) if module is toxicity else (lambda x: module.score(x.select("doc_id", "text"), model).selectExpr("doc_id", "quality_score AS score"))
    assert score(odd).count() == 5 and all(0 <= r["score"] <= 1 for r in score(odd).collect()) and score(docs(spark, [])).count() == 0
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in score(d).collect() if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    ones, zeros = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert auc > least
    assert sum((s >= limit) == y for s, y in held) / len(held) > 0.9
    model = module.train(d, labels.where("false"))
    assert {r["score"] for r in score(odd).collect()} == ({1.0} if module is quality else {0.5})


@needs_tables
def test_pipeline_stages_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    by = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.staged(by["quality"](spark, d, SF), "t")
    assert kept.columns == d.columns and 0.8 < kept.count() / d.count() < 0.95
    one = corpus_pipeline.staged(by["near duplicates"](spark, kept, SF), "t")
    before = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    label = near_groups([t for _, t in before])  # by exact similarity of five-word shingles, not by op2's fingerprints
    assert {r["doc_id"] for r in one.collect()} == {before[g][0] for g in set(label)}
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    clean = corpus_pipeline.staged(by["repeated passages"](spark, one, SF), "t")
    want = {i: (n, h) for i, _, n, h in brute_substring(rows)}
    for r in clean.collect():
        n, h = want[r["doc_id"]]
        assert hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest() == h and r["n_chars"] == len(r["text"])
        assert n or r["text"] == dict(rows)[r["doc_id"]]
    mixed = corpus_pipeline.staged(by["mix"](spark, clean, SF), "t")
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == copies
    packed = by["pack"](spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == copies
    assert [n for n, _ in corpus_pipeline.STAGES] == list(by) and corpus_pipeline.ORACLE_SQL is None


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_groups(texts):
    """For each text the least position of its component of Jaccard similarity 0.8 or more."""
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))
    size = [len(s) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def near_corpus():
    rng = np.random.default_rng(8)
    rows = [(i, t) for i, t in corpus(9, 40) if i is not None and i != 404]
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
        rows += [(1000 + 3 * i + j, " ".join(w)) for j, w in enumerate((words, mutated(rng, words, 1), mutated(rng, words, 2)))]
    return rows


@pytest.mark.parametrize("group", [2048, 4])
def test_near_copies_of_the_pipeline_have_a_jaccard_of_four_fifths(spark, group, monkeypatch):
    from ledgerloom.llm import nearcopies

    monkeypatch.setattr(nearcopies.links, "__defaults__", (group,))
    rows = near_corpus()
    label = near_groups([t for _, t in rows])
    want = {min(i for (i, _), x in zip(rows, label, strict=True) if x == g) for g in set(label)}
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    got = [r["doc_id"] for r in stage(spark, docs(spark, rows), SF).collect()]
    assert sorted(got) == sorted(want)
    assert stage(spark, docs(spark, []), SF).count() == 0


def test_near_copies_without_id_or_of_one_id_go(spark):
    rng = np.random.default_rng(10)
    a, b, c, d = ([f"w{x}" for x in rng.integers(0, 10**6, 60)] for _ in range(4))
    text = " ".join
    rows = [(None, text(a)), (None, text(a)), (None, text(mutated(rng, a, 1))), (7, text(b)), (7, text(b)), (None, text(b)), (9, text(c)), (9, text(mutated(rng, c, 1))), (9, text(d)), (None, None), (None, "")]
    got = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs(spark, rows), SF).collect()]
    assert len(got) == 5 and got.count((7, text(b))) == 1 and got.count((9, text(d))) == 1
    assert sum(i == 9 for i, _ in got) == 2 and sum(i is None and bool(t) for i, t in got) == 1 and sum(not t for _, t in got) == 1
    same = [(1, text(a), "en", source, 0, "z", "z") for source in "ba"] * 2
    assert [r["source"] for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, spark.createDataFrame(same, DOCS), SF).collect()] == ["a"]
