"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text compared window by window."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir, text_of, train_rows, written

#: Labelled documents that are learned from at most, of either class; word stems that tell the classes apart; windows of either
#: class that dictionaries are trained on; bytes of each dictionary.
SAMPLE, STEMS, WINDOWS, ORDINARY, TOXIC = 3000, 800, 8000, 8 << 10, 16 << 10
#: Words of a window; compression level; bytes of a stem.
WINDOW, LEVEL, STEM = 8, 9, (5, 8)
#: Ends both dictionaries and begins each window: zstandard stores short blocks as they are unless something in them matches.
MARK = bytes(range(1, 17))
#: A stem may occur in this share of ordinary documents, in parts of its share of toxic ones.
PURE = 0.03
FOLDS, HELD_OUT, CUT = 4, 2, 0.3


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The words of a text, A-Z in lower case and without marks around them, `size` to a window, spaces on both ends."""
    words = [w for w in (x.strip(b".,;:!?\"'()*%$#&|-") for x in text.encode("utf-8", "surrogatepass").lower().split()) if w]
    return [b" " + b" ".join(words[k : k + size]) + b" " for k in range(0, len(words), size)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: Means, spreads and weights of the evidence, the offset last among the weights.
    scale: tuple[np.ndarray, np.ndarray, np.ndarray]
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "scale": self.scale, "_made": []}

    def _compressors(self):
        if not self._made:
            import zstandard as z

            for content in (self.ordinary, self.toxic):
                d = z.ZstdCompressionDict(content + MARK, dict_type=z.DICT_TYPE_RAWCONTENT)
                p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
                d.precompute_compress(compression_params=p)
                self._made.append(z.ZstdCompressor(compression_params=p, dict_data=d))
        return self._made

    def evidence(self, text: str) -> list[float]:
        """Of the gains, bytes that each window takes less with the toxic dictionary than with the ordinary one: the greatest
        ones, and how many windows reach each threshold."""
        one, other = (c.compress for c in self._compressors())
        gain = sorted((len(one(MARK + w)) - len(other(MARK + w)) for w in windows(text)), reverse=True)
        top = [*gain[:5], 0, 0, 0, 0, 0]
        reach = [sum(g >= t for g in gain) for t in (3, 4, 5, 6)]
        return [top[0], top[1], top[2], top[4], math.log1p(len(gain)), reach[0] / (1 + len(gain)), *(math.log1p(r) for r in reach[1:])]

    def score(self, texts: list[str]) -> np.ndarray:
        mean, spread, w = self.scale
        x = (np.array([self.evidence(t) for t in texts], float).reshape(-1, len(mean)) - mean) / spread
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression of labels on evidence; labels of one class only give every text the share of that class."""
    mean, spread, w = x.mean(0), x.std(0) + 1e-6, np.zeros(x.shape[1] + 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = math.log(share / (1 - share))
    if y.min() == y.max():
        return mean, spread, w
    a = np.c_[(x - mean) / spread, np.ones(len(x))]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1]), a.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return mean, spread, w


def stems_in(word: bytes, sizes: tuple[int, ...] = STEM) -> set[bytes]:
    """The runs of each of `sizes` bytes of a word with a space on both ends; a word shorter than all, whole."""
    word = b" " + word + b" "
    return {word[k : k + n] for n in sizes for k in range(len(word) - n + 1)} or {word}


def _stems(sample: DataFrame, most: int) -> list[bytes]:
    """Runs of bytes within words that occur in more of the toxic documents than in the ordinary ones, surely so (z score of
    the two shares above 6) and nearly only there, after words of many kinds."""

    def rows(c: dict) -> Iterator[tuple]:
        count: dict[bytes, list[int]] = {}
        for y, text in zip(c["label"], c["text"]):
            for stem in set().union(*map(stems_in, {w for x in windows(text) for w in x.split()})):
                count.setdefault(stem, [0, 0])[y] += 1
        return [(k, *v) for k, v in count.items()]

    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return []
    count = arrow_map(sample, rows, "stem binary, ordinary int, toxic int", 1024).groupBy("stem").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t"))
    p, q = F.col("t") / size[1], F.col("o") / size[0]
    both = (F.col("t") + F.col("o")) / (size[0] + size[1])
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / size[0] + 1 / size[1]) + F.lit(1e-12))
    least = 6.0 * min(1.0, min(size.values()) / 1000) ** 0.25
    sure = count.withColumn("z", z).filter((F.col("z") > least) & (q <= PURE * p) & (F.col("t") >= 3))
    found = {bytes(r.stem): r.t for r in sure.orderBy(F.desc("z"), "stem").limit(4 * most).collect()}
    spread = sample.sparkSession.sparkContext.broadcast(set(found))

    def before(c: dict) -> Iterator[tuple]:
        """Each stem with the word before it: copies of a document give one pair, however many they are."""
        pairs = set()
        for text in c["text"]:
            last = b""
            for word in (w for x in windows(text) for w in x.split()):
                pairs.update((stem, last) for stem in stems_in(word) & spread.value)
                last = word
        return list(pairs)

    pairs = arrow_map(sample.filter("label = 1"), before, "stem binary, word binary", 1024).distinct().groupBy("stem").count()
    varied = {bytes(r.stem) for r in pairs.collect() if r["count"] >= max(5, 0.3 * found[bytes(r.stem)])}
    return [x for x in found if x in varied][:most]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, stems: int = STEMS, most: int = WINDOWS) -> Model:
    """Trains on at most `sample` labelled documents of each class, chosen by a hash of doc_id, held-out rows excluded.

    On two thirds of them: the ordinary dictionary on windows of documents labelled 0. Most windows of a document labelled
    1 are ordinary too; the toxic dictionary is trained on its words with stems that mark the class, and is laid before the
    ordinary content, so that the two differ in what is toxic alone. On the last third, which no dictionary has seen: the
    thresholds' weights and the scale of the score. Labels of one class only: every text scores the share of that class.
    No labels: 0.5.
    """
    import zstandard as z

    folder = shared_dir(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.filter(train_rows(F.col("doc_id"), FOLDS, HELD_OUT)).select(F.col("doc_id").alias("label_id"), "label")
    few = None
    for y in (0, 1):
        part = known.filter(F.col("label") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
        few = part if few is None else few.unionByName(part)
    # At most 2 * sample ids, so they may go to every task.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3))), "sample", folder)
    known, rows = rows.filter("part = 0"), rows.filter("part > 0").drop("part")
    marked = set(_stems(rows, stems))
    spread = docs.sparkSession.sparkContext.broadcast(marked)

    def chosen(c: dict) -> Iterator[tuple]:
        """Of each document the windows to train on: the marked ones of a toxic one, some of an ordinary one."""
        for doc, y, text in zip(c["doc_id"], c["label"], c["text"]):
            found = windows(text)
            if y:
                for word in (x for w in found for x in w.split()):
                    if not spread.value.isdisjoint(stems_in(word)):
                        yield doc, 1, b" " + word + b" "
            else:
                step = max(1, len(found) // 16)
                yield from ((doc, 0, w) for w in found[::step])

    pick = arrow_map(rows, chosen, "doc_id long, label int, w binary")
    content = []
    for y, size in ((0, ORDINARY), (1, TOXIC)):
        got = [bytes(r.w) for r in pick.filter(F.col("label") == y).orderBy(F.xxhash64("w", "doc_id"), "w").limit(most).collect()]
        try:
            content.append(z.train_dictionary(size, got, level=LEVEL).as_bytes())
        except z.ZstdError:  # too few or too small for the trainer: the text itself
            content.append(b"".join(dict.fromkeys(got))[:size])
    blank = 9  # figures of evidence
    model = Model(content[0], content[1] + content[0], (np.zeros(blank), np.ones(blank), np.zeros(blank + 1)))
    spread_model = docs.sparkSession.sparkContext.broadcast(model)

    def measured(c: dict) -> Iterator[tuple]:
        return [(doc, y, spread_model.value.evidence(text)) for doc, y, text in zip(c["doc_id"], c["label"], c["text"])]

    # Of several rows with one doc_id one counts, so no more come than were sampled.
    few = arrow_map(known, measured, "doc_id long, label int, x array<double>").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    found = sorted((r.doc_id, r.label, r.x) for r in few.collect())
    if found:
        model = Model(model.ordinary, model.toxic, calibrated(np.array([r[2] for r in found]), np.array([r[1] for r in found], float)))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null text counts as empty. A null doc_id isn't held out. Repeated rows
    are each scored, whole texts however long, and other columns, whatever their names, are left; an empty table gives an
    empty result."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def rows(c: dict) -> Iterator[tuple]:
        s = spread.value.score(c["text"])
        return [(d, bool(h), float(v), int(v >= CUT)) for d, h, v in zip(c["doc_id"], c["held"], s)]

    held = F.coalesce(~train_rows(F.col("doc_id"), FOLDS, HELD_OUT), F.lit(False))
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), held.alias("held")), rows, "doc_id long, held_out boolean, score double, predicted int")
