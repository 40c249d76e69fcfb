"""Line dedup, collocations and whitening against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import lines, phrases, whitening

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept_sha256 string, n int"


def docs(spark, rows):
    """rows: (doc_id, text, lang); other columns bear names that results use."""
    return spark.createDataFrame([(i, t, lang, None, None, "x", 1) for i, t, lang in rows], COLUMNS).repartition(3)


def brute_lines(rows, least_docs=3, least_chars=20):
    held = defaultdict(set)
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    low = lambda i: -(2**63) if i is None else i
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(low(i))
    gone = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for i, text, _ in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if gone.get(key(x), low(i)) == low(i)]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return Counter(out)


def line_rows():
    pick = random.Random(7)
    common = [f"  Line number {j} that Ümlauts and many documents share \t" for j in range(40)]
    rows = []
    for i in range(150):
        own = [pick.choice(common).upper() if pick.random() < 0.2 else pick.choice(common) for _ in range(pick.randrange(0, 6))]
        own += [f"own line of document {i} no {j}" for j in range(pick.randrange(0, 3))] + [""] * pick.randrange(0, 2)
        pick.shuffle(own)
        rows.append((i if i % 17 else None, "\n".join(own), "en"))
    short, exact = "é" * 19, "é" * 20
    rows += [(200 + i, f"{short}\n{exact}\n{exact} \r", "de") for i in range(4)] + [(300, None, None), (301, "", "en"), (302, "\n\n", "en")]
    rows += [(400, common[0], "en")] * 3 + [(5, common[1] + "\n" + common[1], "en"), (500, (common[2] + "\n") * 5000, "en")]
    return rows


@pytest.mark.parametrize("shard, most", [(1 << 16, 1 << 21), (4, 6)])
def test_lines_as_brute_force(spark, monkeypatch, shard, most):
    """In one round and in several."""
    monkeypatch.setattr(lines, "SHARD", shard)
    monkeypatch.setattr(lines, "ROUND", most)
    rows = line_rows()
    want = brute_lines(rows)
    got = lines.dedup(docs(spark, rows))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert Counter(map(tuple, got.collect())) == want
    hashed = lines.dedup(docs(spark, rows), hashed=True)
    assert Counter(map(tuple, hashed.collect())) == Counter({(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()): n for r, n in want.items()})


def test_lines_of_unique_ids_and_of_no_rows(spark):
    rows = [(i, "a line that stands in all of the documents\nshort", "en") for i in range(5)]
    assert Counter(map(tuple, lines.dedup(docs(spark, rows)).collect())) == brute_lines(rows)
    assert lines.dedup(docs(spark, rows).where("false")).collect() == []


def test_every_key_has_a_place_of_its_own():
    pick = np.random.default_rng(3)
    both = pick.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    both[1:40, 0] = both[0, 0]  # equal first halves
    of, rows = 3, []
    for shard in range(of):
        own = both[lines.shard_of(both[:, 0], of) == shard]
        levels, bits, order = lines.build_shard(own[:, 0], own[:, 1])
        assert sorted(order) == list(range(len(own)))
        data = own[order, 1]
        rows.append({"shard": shard, "levels": levels, "bits": bits.tobytes(), "fingerprints": data.tobytes(), "counts": data.tobytes(), "last": data.tobytes()})
    index = lines.Index(rows, of)
    places = index.places(both)
    assert sorted(places) == list(range(len(both))) and (index.fingerprints[places] == both[:, 1]).all()
    assert (index.places(pick.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)) == -1).all()
    assert (lines.Index(rows[1:], of).places(both)[lines.shard_of(both[:, 0], of) == 0] == -1).all()
    with pytest.raises(ValueError):
        lines.build_shard(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def brute_phrases(rows, least, first):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        long = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in long.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in long.items()):
                continue
            score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def phrase_rows():
    pick = random.Random(11)
    words = ["a", "b", "of", "the", "Zürich", "zebra", "𝔘x", "\x00", "x y", "New", "york", "City"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(pick.randrange(0, 60)):
            parts.append(pick.choice(words) if pick.random() < 0.7 else "New York  city hall")
            parts.append(pick.choice([" ", " ", " ", "\t", ". ", ",", "\n", " ;: "]))
        rows.append((i, "".join(parts), pick.choice(["en", "de", None, "und"])))
    rows += [(None, None, "en"), (1, "", "en"), (1, " .,; \n", "fr")] + [(7, "the very same text stands here again. and again", "en")] * 40
    return rows + [(900, "a " * 30000, "en"), (901, "q", "it")]


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_phrases_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "FILTER", 1 << 16)
    rows = phrase_rows()
    for least, first in ((5, 2000), (30, 7)):
        got = phrases.collocations(docs(spark, rows), least, first)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert Counter(map(tuple, got.collect())) == brute_phrases(rows, least, first)
    assert phrases.collocations(docs(spark, rows).where("false")).collect() == []


@pytest.mark.parametrize("period, most", [(1, 2048), (3, 2048), (10**9, 5), (7, 1)])
def test_chunks_hold_each_start_once(period, most):
    pick = random.Random(5)
    words = phrases.tokens(" ".join(pick.choice(["one", "two", "three,", ".", "A", "a"]) for _ in range(500)).encode())
    assert phrases.chunks([], period) == [] and words[0] != b"\n"
    parts = [c.split(b" ") for c in phrases.chunks(words, period, most)]
    assert [w for p in parts for w in p[: -phrases.OVERLAP]] == words
    starts = [p[:3] for p in parts[1:]]
    assert [p[-3:] for p in parts[:-1]] == starts and parts[-1][-3:] == [b"\n"] * 3


def test_scores_beyond_64_bits(spark):
    """Counts near the end of 64 bits: products need more."""
    big = 9 * 10**18
    rows = [("en", "x", 1, big), ("en", "y", 1, big // 3), ("en", "x y", 2, big // 3), ("en", "x y x", 3, big // 3 * 8 // 10)]
    got = {r["phrase"]: tuple(r) for r in phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()}
    a = big // 3 * 8 // 10
    cuts = [(2000000 * a // (big + big), 1), (2000000 * a // (big // 3 + big), 2)]
    assert "x y" not in got and cuts[0] < cuts[1]
    rows[3] = ("en", "x y x", 3, a - 1)
    rows.append(("en", "y x", 2, big))
    got = {r["phrase"]: tuple(r) for r in phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()}
    assert got["x y"] == ("en", "x y", big // 3, big, big // 3, 2000000 * (big // 3) // (big + big // 3))
    assert got["x y x"][3:5] == (big, big)


def whiten_rows(n=400, d=24, seed=1):
    pick = np.random.default_rng(seed)
    x = pick.standard_normal((n, d)) * np.linspace(2, 0.2, d)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n + i, rows[3][1]) for i in range(200)] + [(3, rows[3][1]), (None, rows[4][1])]
    bad = [None, [], [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [1.0] * (d - 1)]
    return rows + [(2000 + i, v) for i, v in enumerate(bad)], rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, component string").repartition(4)


def test_whitening_as_numpy(spark):
    rows, good = whiten_rows()
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 16 * len(good)
    x = np.floor(np.array([v for _, v in good]) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    want = ((n * x - sums) / n) @ axes / np.sqrt(values)
    deviation = [sum(int(c) ** 2 for c in r) for r in n * x - sums]
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    rows_of = defaultdict(list)
    for r in got:
        rows_of[r["component"]].append((r["vec_id"] is None, r["vec_id"] or 0, r["whitened"], r["deviation"]))
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(y.T @ y / n)) < 1e-12
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0))
    for k in range(1, 17):
        own = sorted(rows_of[k], key=lambda r: r[:2])
        white = np.array([r[2] for r in own])
        sign = np.sign(white @ want[order, k - 1])
        assert np.abs(sign * white - want[order, k - 1]).max() < 1e-8
        assert [r[3] for r in own] == [deviation[j] for j in order]


def test_whitening_of_odd_tables(spark):
    few = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]  # on one line: one component
    got = whitening.whiten(frame(spark, few)).collect()
    assert len(got) == 5 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []
    assert whitening.whiten(frame(spark, few).where("false")).collect() == []
    assert len(whitening.whiten(frame(spark, [(1, [0.5]), (2, [0.1])])).collect()) == 2
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e30]), (2, [0.1])])).collect()


def test_large_entries_stay_exact(spark):
    """Products beyond 64 bits in the covariance; a deviation beyond them is an error."""
    rows = frame(spark, [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 3.0]), (3, [0.0, 2.0])])
    x = [[2**46 + 10**6, 64 + 10**6], [-(2**46) + 10**6, 192 + 10**6], [10**6, 128 + 10**6]]
    n, sums, matrix = whitening.covariance(whitening.integers(rows).select("x"), 2)
    assert (n, sums) == (3, [sum(c) for c in zip(*x, strict=True)])
    assert matrix[0, 0] == 2 * 2**92 / 3 and matrix[0, 1] == -(2**47) * 64 / 3
    with pytest.raises(Exception, match="leaves 64 bits"):
        whitening.whiten(rows).collect()


@pytest.mark.parametrize("seed", range(6))
def test_principal_axes(seed):
    pick = np.random.default_rng(seed)
    d = [1, 2, 3, 17, 40, 64][seed]
    q, _ = np.linalg.qr(pick.standard_normal((d, d)))
    values = np.sort(pick.random(d))[::-1]
    if seed >= 3:
        values[:4] = 1.0 + np.array([3e-9, 2e-9, 0, 0])  # a cluster with a repeated value
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    k = min(d, 16)
    got, axes = whitening.principal(a, k)
    assert np.abs(got - values[:k]).max() < 1e-13 and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-11
    assert np.abs(a @ axes - axes * got).max() < 1e-12
    diagonal = np.diag(np.diag(a))
    got, axes = whitening.principal(diagonal, k)
    assert np.abs(np.sort(np.diag(a))[::-1][:k] - got).max() < 1e-13 and np.abs(diagonal @ axes - axes * got).max() < 1e-12
