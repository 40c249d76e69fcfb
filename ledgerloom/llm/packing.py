"""Packing token sequences online by the sum-of-squares rule.

Each task packs its own documents as they come: a level array counts the open windows by fill; a
piece goes to the level that makes the sum of squared counts smallest. Full windows leave at once, and
open ones are bounded in number, so a task's memory doesn't grow with its documents. Windows that are open
at the end go into each other by the same rule, cut where they don't fit; less than one window is left then,
cut at powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, table

WINDOW = 1024
#: Windows that a task holds open, at most; some 2 KB each, 4 KB at most.
OPEN = 4096
#: Words that a task keeps the ids of, at most; about 180 bytes each.
CACHED_WORDS = 400_000
#: Characters of texts that are encoded together, about.
TOGETHER = 1 << 20
MARKS = ".,!|*$#%&"
SPECIAL = "<|endoftext|>"
_UNEVEN = ("  ", " \n", "\n ", "\n\n")
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Ids of whole texts, as packed little-endian unsigned 32-bit integers.

    The pre-tokenizer cuts before each single space that follows and precedes non-space, and at each
    single newline; so the ids of such a text are those of its words in turn, kept for the words met
    first. Any other text (odd or repeated white space, the special token's string) is encoded as a whole.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.words = Tokenizer.from_file(path), cached, {}
        self.newline = self.encode("\n")
        self.simple = len(self.newline) == 1
        #: Whether marks after letters are cut off before anything else, so that their ids don't depend on the word.
        self.marked = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("word" + MARKS)][1:] == [MARKS]
        self.marks: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        """The tokenizer's ids, without the offsets that encode() also makes."""
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def learn(self, words: list[str]) -> list[str]:
        """Keep words as cut at spaces; one that starts with a newline follows that, any other a space. Gives
        those that are new, words without their marks included."""
        known, bare = self.words, {}
        for w in words:
            b = w.rstrip(MARKS) if self.marked else w
            if len(b) < len(w) and b.removeprefix("\n").isalpha():
                bare[w] = b
        whole = [w for w in words if w not in bare] if bare else words
        whole = list(dict.fromkeys(whole + [b for b in bare.values() if b not in known]))
        if whole:
            ids = np.array(self.encode("\n".join([w[1:] if w[0] == "\n" else " " + w for w in whole])), "<u4")
            cuts, packed = np.flatnonzero(ids == self.newline[0]) * 4, ids.tobytes()
            first = np.array(self.newline, "<u4").tobytes()
            for w, a, b in zip(whole, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(packed)], strict=True):
                known[w] = first + packed[a:b] if w[0] == "\n" else packed[a:b]
        for w, b in bare.items():  # marks after letters are tokens of their own
            tail = w[len(b) :]
            if tail not in self.marks:
                self.marks[tail] = self.whole(tail)
            known[w] = known[b] + self.marks[tail]
        return [*whole, *bare]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        cut: list = []
        for text in texts:
            if not text:
                cut.append(b"")
            elif not self.simple or any(x in text for x in _UNEVEN) or text[-1] in " \n" or SPECIAL in text:
                cut.append(self.whole(text))
            else:
                cut.append(text.replace("\n", " \n").split(" "))
        known, full = self.words, len(self.words) >= self.cached
        missing = set().union(*[x[1:] for x in cut if isinstance(x, list)]).difference(known)
        if len(" ".join(missing).split()) != len(missing):  # other white space within words
            odd = {w for w in missing if w.split() != [w.removeprefix("\n")]}
            cut = [self.whole(t) if isinstance(x, list) and not odd.isdisjoint(x[1:]) else x for t, x in zip(texts, cut, strict=True)]
            missing -= odd
        new = self.learn(list(missing)) if missing else []
        out = [x if isinstance(x, bytes) else (self.whole(x[0]) if x[0] else b"") + b"".join(map(known.__getitem__, x[1:])) for x in cut]
        if full:
            for w in new:
                del known[w]
        return out

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


def split(pieces: list, room: int) -> tuple[list, list]:
    """The first `room` ids of pieces (doc, start, ids, total), and the others."""
    first: list = []
    for k, (doc, start, ids, total) in enumerate(pieces):
        size = len(ids) // 4
        if size > room:
            head = [(doc, start, ids[: room * 4], total)] if room else []
            return first + head, [(doc, start + room, ids[room * 4 :], total), *pieces[k + 1 :]]
        first.append(pieces[k])
        room -= size
    return first, []


class SumOfSquares:
    """Open windows by fill level, `most` of them at most.

    Pieces go where the sum of squared counts becomes least: whole into a window with room or a new one. Once
    `most` windows are open no piece opens another: it goes into a window with room or, cut, fills a
    window while its rest stays open in that one's stead, whichever makes the sum least. finish() puts the
    open windows into each other by the same rule until one is left.
    """

    def __init__(self, window: int, most: int):
        self.window, self.most, self.held = window, most, 0
        self.counts, self.open = np.zeros(window + 1, np.int64), [[] for _ in range(window + 1)]

    def level(self, size: int, new: bool) -> int:
        """The fill level that pieces of `size` ids go to; 0: a new window. Ties go to whole pieces, then to the fullest."""
        n, fits = self.counts, self.window - size
        change = 2 - 2 * n[: fits + 1] + 2 * n[size:]
        change[0] = 2 * n[size] + 1
        change[fits] = 1 - 2 * n[fits] if fits else -1  # the window is full then and counts no more
        usable = n[: fits + 1] > 0
        usable[0] = new
        levels = np.flatnonzero(usable)[::-1]
        whole = levels[np.argmin(change[levels])] if len(levels) else None
        if new:
            return int(whole)
        over = fits + 1 + np.flatnonzero(n[fits + 1 : self.window])[::-1]
        if not len(over):
            return int(whole)
        cut = 2 - 2 * n[over] + 2 * n[over - fits]
        best = int(np.argmin(cut))
        return int(whole) if whole is not None and change[whole] <= cut[best] else int(over[best])

    def take(self, level: int) -> list:
        self.counts[level] -= 1
        self.held -= 1
        return self.open[level].pop()

    def hold(self, pieces: list, level: int) -> None:
        self.counts[level] += 1
        self.held += 1
        self.open[level].append(pieces)

    def put(self, pieces: list, size: int, new: bool | None = None) -> list | None:
        """Place pieces of `size` ids in all, fewer than a window; the window that became full, if one did."""
        at = self.level(size, self.held < self.most if new is None else new)
        inside, room = (self.take(at) if at else []), self.window - at
        if size > room:
            pieces, rest = split(pieces, room)
            self.hold(rest, size - room)
        if size >= room:
            return inside + pieces
        self.hold(inside + pieces, at + size)
        return None

    def finish(self) -> Iterator[list]:
        """Full windows, then the last open one cut at powers of two, which need no padding."""
        while self.held > 1:
            level = self.window - int(np.argmax(self.counts[::-1]))  # of the most frequent levels the fullest
            if done := self.put(self.take(level), level, new=False):
                yield done
        for level in np.flatnonzero(self.counts):
            pieces, left = self.take(int(level)), int(level)
            while left:
                size = 1 << (left.bit_length() - 1)
                head, pieces = split(pieces, size)
                left -= size
                yield head


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0, tasks: int | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` ids: SCHEMA.

    ids holds the piece's ids as packed little-endian unsigned 32-bit integers. Null text is empty: its
    document is the end id alone. Null ids are kept. Equal rows are packed each by itself; other columns
    are ignored. An empty table gives no sequence. A sequence's id is its task's number, then a count.

    tasks: partitions are joined to so many, without a shuffle; the more texts a task has, the fewer documents
    are cut and the fewer words are encoded again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = Ids(tokenizer_path), SumOfSquares(window, OPEN), int(end_id).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in SCHEMA.split(", ")]

        def emit(pieces: list) -> None:
            nonlocal sequence, held
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence, held = sequence + 1, held + offset

        def out() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple]:
            """(doc_id, ids); a few texts at a time become Python's."""
            docs, texts, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                docs.append(doc.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size > TOGETHER:
                    yield from zip(docs, encode.many(texts), strict=True)
                    docs, texts, size = [], [], 0
            yield from zip(docs, encode.many(texts), strict=True)

        for batch in batches:
            for doc, ids in encoded(batch):
                ids += end
                total = len(ids) // 4
                full = total - total % window
                for start in range(0, full, window):
                    emit([(doc, start, ids[start * 4 : (start + window) * 4], total)])
                if full < total and (done := packer.put([(doc, full, ids[full * 4 :], total)], total - full)):
                    emit(done)
                if held > 1_000_000:
                    yield out()
        for pieces in packer.finish():
            emit(pieces)
            if held > 1_000_000:
                yield out()
        if rows:
            yield out()
        encode.words.clear()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return small_batches(rows.coalesce(tasks) if tasks else rows).mapInArrow(run, SCHEMA)


def fewer_tasks(docs: DataFrame, together: int = 4) -> int:
    """For docs read from files: a task for every few partitions, but one for each core at least."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // together)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return digest(pack(docs, public_tokenizers.path("byte_bpe_50k.json"), tasks=fewer_tasks(docs)))
