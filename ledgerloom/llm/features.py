"""Hashed n-grams of whole texts as arrays, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

_STEP = 1 << 20
_MIX = 0x9E3779B97F4A7C15


def gram_hashes(data: bytes, n: int, bits: int) -> Iterator[np.ndarray]:
    """Hashes below 2**bits of every n consecutive bytes (n <= 8), in pieces of bounded size."""
    b = np.frombuffer(data, np.uint8)
    factor, shift = np.uint64((_MIX * (2 * n + 1)) % (1 << 64)), np.uint64(64 - bits)
    for start in range(0, max(0, len(b) - n + 1), _STEP):
        part = b[start : start + _STEP + n - 1]
        m = len(part) - n + 1
        code = part[:m].astype(np.uint64)
        for j in range(1, n):
            code <<= np.uint64(8)
            code |= part[j : j + m]
        code *= factor
        code >>= shift
        yield code.astype(np.int64)


def character_hashes(text: str, n: int, bits: int) -> Iterator[np.ndarray]:
    """Hashes below 2**bits of every n consecutive code points, in pieces of bounded size."""
    last, shift = np.uint64((_MIX * (2 * n + 1)) % (1 << 64)), np.uint64(64 - bits)
    for start in range(0, max(0, len(text) - n + 1), _STEP):
        part = np.frombuffer(text[start : start + _STEP + n - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        m = len(part) - n + 1
        code = part[:m].copy()
        for j in range(1, n):  # modulo 2**64
            code *= np.uint64(_MIX)
            code += part[j : j + m]
        code ^= code >> np.uint64(32)
        code *= last
        code >>= shift
        yield code.astype(np.int64)


def sample_rate(rows: int, most: int) -> float:
    return 1.0 if rows <= most else most / rows


def in_sample(doc_id: Column, rate: float | Column) -> Column:
    """The same share of ids on every run."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("sample")), F.lit(1 << 30).cast("long")) < F.floor(rate * (1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int | dict[int, int]) -> DataFrame:
    """(text, label) of a bounded sample of labelled rows outside the held-out fold.

    most: rows at most, about; or those of each label. Null ids and labels other than 0 and 1 are left
    out; a document with several labels counts once for each.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(fold(F.col("doc_id")) != 0)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if isinstance(most, dict):
        rates = {k: sample_rate(counts.get(k, 0), most[k]) for k in (0, 1)}
    else:
        rates = dict.fromkeys((0, 1), sample_rate(sum(counts.values()), most))
    picked = known.where(F.when(F.col("label") == 1, in_sample(F.col("doc_id"), rates[1])).otherwise(in_sample(F.col("doc_id"), rates[0])))
    picked = picked.distinct()  # `most` rows, about
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label"), {k: (counts.get(k, 0), rates[k]) for k in (0, 1)}
