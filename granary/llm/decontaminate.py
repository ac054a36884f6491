"""Benchmark decontamination by a prefix-filtered set join and exact checks over item-sized windows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, WORD_BYTES, arrow_map, shared_dir, text_of, written

#: Item words that a task gets at once. Larger benchmarks are joined in blocks of this size, each by its own pass.
BLOCK_WORDS = 200_000


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z in lower case, cut at every ASCII character that is no digit or letter."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def shingles_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Pairs of neighbouring words; a single word is a shingle of its own."""
    return list(zip(words, words[1:])) if len(words) > 1 else [tuple(words)] if words else []


class Windows:
    """The windows of a block of items, to be found by the rarest shingle of each.

    A document that holds a window holds all its shingles, so the necessary prefix of the window, with shingles in order of
    rarity, is the first one. The shingle's place in the window bounds where the window can start and end; the words there
    are then compared exactly.
    """

    def __init__(self, items: list[tuple[str, str]], size: int, count: dict[tuple[bytes, ...], int]):
        self.items: list[str] = [i for i, _ in items]
        self.of: dict[tuple[bytes, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            for at in range(max(1, len(words) - size + 1) if words else 0):
                self.of.setdefault(tuple(words[at : at + size]), set()).add(k)
        #: By first word of the prefix shingle: its second word (None: no other) and the places (offset, length) of it.
        self.prefix: dict[bytes, dict[bytes | None, set[tuple[int, int]]]] = {}
        for window in self.of:
            shingles = shingles_of(list(window))
            offset, rarest = min(enumerate(shingles), key=lambda x: (count.get(x[1], 0), x[1], x[0]))
            second = rarest[1] if len(rarest) > 1 else None
            self.prefix.setdefault(rarest[0], {}).setdefault(second, set()).add((offset, len(window)))

    def hits(self, words: list[bytes]) -> tuple[bytearray, set[int]]:
        """Which words lie in an occurrence of a window, and the items with occurring windows."""
        hit, found, prefix, of = bytearray(len(words)), set(), self.prefix, self.of
        for p in [p for p, w in enumerate(words) if w in prefix]:
            places = prefix[words[p]]
            follows = words[p + 1] if p + 1 < len(words) else None
            for second in {follows, None}:
                for offset, length in places.get(second, ()):
                    start = p - offset
                    if start >= 0 and start + length <= len(words) and (items := of.get(tuple(words[start : start + length]))):
                        hit[start : start + length] = b"\1" * length
                        found |= items
        return hit, found


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[str, str]]]:
    """Items (id as text, text) in blocks of about BLOCK_WORDS words, one at a time on the driver. A longer item is cut into
    parts of BLOCK_WORDS words, each with the first words of the next, so that every window lies in one."""
    block, words = [], 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text")).filter("item_id is not null")
    for item in items.toLocalIterator():
        found = words_of(item.text)
        for at in range(0, max(1, len(found) - (size - 1)), max(size, BLOCK_WORDS)):
            part = found[at : at + max(size, BLOCK_WORDS) + size - 1]
            if block and words + len(part) > BLOCK_WORDS:
                yield block
                block, words = [], 0
            block.append((item.item_id, b" ".join(part).decode("utf-8", "surrogatepass")))
            words += len(part)
    if block:
        yield block


def shingle_counts(docs: DataFrame, shingles: set[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """How often each of a block's shingles occurs in all documents: summed in the tasks, then over them."""
    known = docs.sparkSession.sparkContext.broadcast({s: k for k, s in enumerate(sorted(shingles))})
    firsts = docs.sparkSession.sparkContext.broadcast({s[0] for s in shingles})

    def rows(c: dict) -> Iterator[tuple]:
        number, first, count = known.value, firsts.value, Counter()
        for text in c["text"]:
            words = words_of(text)
            last = len(words) - 1
            for p in [p for p, w in enumerate(words) if w in first]:
                if p < last and (k := number.get((words[p], words[p + 1]))) is not None:
                    count[k] += 1
                if (k := number.get((words[p],))) is not None:
                    count[k] += 1
        return list(count.items())

    found = arrow_map(docs.select(text_of().alias("text")), rows, "shingle long, n long", 4096).groupBy("shingle").agg(F.sum("n").alias("n"))
    by = sorted(shingles)
    return {by[r.shingle]: r.n for r in found.toLocalIterator()}


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document.

    A window is `size` consecutive words of an item, or all of a shorter one. Null texts have no words; items with a null
    id or no words have no windows; repeated items count once; repeated rows of documents are each judged. Empty tables
    are fine on either side. The benchmark goes to the tasks in blocks of about BLOCK_WORDS words. Where there are several,
    each takes a pass that writes what it found, without the texts, and what was found in a row is put together at the end.
    """
    folder = shared_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    blocks = _blocks(benchmark, size)
    block, found = next(blocks, []), None
    while True:
        following = next(blocks, None)
        windows = _windows(docs, block, size)
        if following is None and found is None:
            return arrow_map(rows.select("doc_id", "text"), lambda c, w=windows: _judge(c, w.value), RESULT)
        part = written(arrow_map(rows.select("row", "text"), lambda c, w=windows: _collect(c, w.value), FOUND), "found", shared_dir(docs.sparkSession))
        found = part if found is None else found.unionByName(part)
        if following is None:
            break
        block = following
    # At most one row of a document for each block.
    found = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    size_of = written(arrow_map(rows, lambda c: [(d, r, len(words_of(t))) for d, r, t in zip(c["doc_id"], c["row"], c["text"])], "doc_id long, row long, n_words long"), "words", folder)
    both = size_of.join(found, "row", "left").select("doc_id", "n_words", "spans", "items")
    return arrow_map(both, _put_together, RESULT)


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
FOUND = "row long, spans array<int>, items array<string>"


def _windows(docs: DataFrame, block: list[tuple[str, str]], size: int):
    shingles = {s for _, text in block for s in shingles_of(words_of(text))}
    return docs.sparkSession.sparkContext.broadcast(Windows(block, size, shingle_counts(docs, shingles) if shingles else {}))


def _row(doc, n_words: int, hit: bytearray, names: list[str]) -> tuple:
    n = sum(hit)
    return doc, n_words, n, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n > 0


def _judge(c: dict, windows: Windows) -> Iterator[tuple]:
    for doc, text in zip(c["doc_id"], c["text"]):
        words = words_of(text)
        hit, found = windows.hits(words)
        yield _row(doc, len(words), hit, sorted({windows.items[k] for k in found}))


def _collect(c: dict, windows: Windows) -> Iterator[tuple]:
    for row, text in zip(c["row"], c["text"]):
        hit, found = windows.hits(words_of(text))
        if found:
            yield row, [x for m in re.finditer(rb"\x01+", bytes(hit)) for x in m.span()], sorted({windows.items[k] for k in found})


def _put_together(c: dict) -> Iterator[tuple]:
    for doc, n, spans, items in zip(c["doc_id"], c["n_words"], c["spans"], c["items"]):
        hit = bytearray(n)
        for a, b in zip(spans[::2], spans[1::2]) if spans else ():
            hit[a:b] = b"\1" * (b - a)
        yield _row(doc, n, hit, sorted(items or ()))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, all columns, without those that hold a window of the benchmark. Null texts hold none; an empty table on
    either side is fine. Several blocks take a pass each, whose rest is written."""
    blocks, kept = _blocks(benchmark, size), docs
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        windows = _windows(docs, block, size)

        def run(batches: Iterator[pa.RecordBatch], w=windows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    texts = part.column(part.schema.names.index("text")).to_pylist()
                    yield part.filter(pa.array([not any(w.value.hits(words_of(x or ""))[0]) for x in texts]))

        kept = kept.mapInArrow(run, kept.schema)
        if following is not None:
            kept = written(kept, "clean")
        block = following
    return kept
