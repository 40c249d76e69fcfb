"""Stages of the pipeline on tables that are empty, full of nulls or have columns of clashing names."""

import os

import pytest

import corpus_pipeline
from ledgerloom.llm import neighbours, quality, topk

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
STAGES = dict(corpus_pipeline.STAGES)
ROWS = "doc_id long, text string, lang string, source string, n_chars long, row string, k0 long, size long, h string, quality_score double, id long"
WORDS = " ".join(f"word{i} is here and there" for i in range(40))
ODD = [
    (1, WORDS + ".", "en", "a", 5, "r", 1, 1, "h", 0.1, 1), (1, WORDS + ".", "en", "a", 5, "r", 1, 1, "h", 0.1, 1), (None, WORDS + " more", None, None, None, None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "r", 1, 1, "h", 0.1, 1), (3, "one", "en", "b", 3, "r", 1, 1, "h", 0.1, 1), (4, WORDS * 30, "en", "b", 3, "r", 1, 1, "h", 0.1, 1),
]


@needs_tables
@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_empty_and_odd_tables(spark, name):
    odd, empty = spark.createDataFrame(ODD, ROWS), spark.createDataFrame([], ROWS)
    assert STAGES[name](spark, empty, SF).count() == 0
    got = STAGES[name](spark, odd, SF)
    rows = [r.asDict() for r in got.collect()]
    if name == "pack":
        assert sum(r["start"] == 0 for r in rows) == len(ODD)
        return
    assert got.columns == list(corpus_pipeline.COLUMNS)
    texts = [(r["doc_id"], r["text"]) for r in rows]
    if name == "quality":
        assert set(texts) <= {(r[0], r[1]) for r in ODD}
    if name == "near duplicates":  # the first group is one document, with what repeats it; null and empty texts are another
        assert sorted(texts, key=repr) == sorted([(1, WORDS + "."), (2, ""), (3, "one")], key=repr)
        assert [i for i, _ in texts].count(1) == 1
    if name == "repeated passages":  # equal ids aren't earlier than each other; a null id comes last
        assert texts.count((1, WORDS + ".")) == 2 and (None, None) in texts and (3, "one") in texts
        assert not any(i is None and t and len(t) > 100 for i, t in texts)
    if name == "mix":
        assert {i for i, _ in texts} <= {1, 2, 3, 4, None}


def test_a_score_column_is_replaced(spark):
    odd = spark.createDataFrame(ODD, ROWS)
    got = quality.score(odd, None)
    assert got.columns.count("quality_score") == 1 and {r["quality_score"] for r in got.collect()} == {1.0}


VECTORS = "vec_id long, embedding array<double>"


def test_huge_vectors_take_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [2.0, 0.0]), (3, [1e200, 1.0]), (100, [1e250, -1e250]), (5, [1e300, 1e308])]
    got = neighbours.search(spark.createDataFrame(rows, VECTORS), modulus=100).orderBy("query_id", "rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0] == [(5, 1e300), (100, 1e250), (3, 1e200), (2, 2.0), (1, 0.5)]
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [3, 2, 0, 1, 5] and got[-1]["score"] == float("-inf")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(spark.createDataFrame(rows, VECTORS), modulus=100).collect()
    near = [(0, [2.0**25]), (1, [2.0**25]), (2, [1.0])]  # each fits, a product doesn't
    with pytest.raises(Exception, match="(?i)overflow|too large|int64"):
        topk.search(spark.createDataFrame(near, VECTORS), modulus=100).collect()


@pytest.mark.parametrize("search", [topk.search, neighbours.search])
def test_an_id_counts_once_with_its_least_vector(spark, search):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 4.0]), (1, [3.0, 0.0]), (1, [0.5, 4.0]), (2, [2.0, 2.0])]
    got = search(spark.createDataFrame(rows, VECTORS), modulus=100).orderBy("rank").collect()
    one = 1024**2 if search is topk.search else 1.0
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 4 * one), (0, 2, 2 * one)]
