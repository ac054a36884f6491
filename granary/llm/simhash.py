"""SimHash near-duplicates: exact comparison of fingerprint tiles by exclusive-or and bit counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, gathered, shared_dir, text_of, written
from .components import components
from .tokens import forget

#: Fingerprints that a tile holds: eight times the root of their number, so that there are tasks enough, within these bounds.
TILE = (1024, 16_384)
#: Shingle sets that a tile holds where links are confirmed.
SETS = 512
#: Least hashes of a shingle set, each under an order of its own, of which similar sets are to share one: sets alike in s share
#: none with a chance of (1 - s) ** MINIMA.
MINIMA = 8
#: Rows of a table that is broadcast; larger ones are joined.
BROADCAST_ROWS = 100_000
#: Bytes of a row of figures about a document, and of each 64-bit word that goes with it.
ROW, WORD = 64, 8
#: Sides of the blocks within which one tile pair is compared at a time; a block's differences stay in a core's cache.
BLOCK = 256


def _bit_table() -> np.ndarray:
    """Which bits each byte value sets, for each of a word's eight bytes: 2048 rows of 64."""
    out = np.zeros((2048, 64), np.int64)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    for k in range(8):
        out[256 * k : 256 * k + 256, 8 * k : 8 * k + 8] = bits
    return out


_BITS = _bit_table()
_OFFSET = (np.arange(8) * 256).astype(np.int64)
#: Odd factors and masks, from one generator: each pair orders the hashes anew.
_ORDERS = np.random.default_rng(17).integers(0, 1 << 63, (2, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `words` words, repeats included; fewer words make one shingle, none none."""
    import xxhash

    found = text.encode().lower().split()  # A-Z only; cuts at U+0020 and U+0009 to U+000D
    if not found:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hashed(joined, 42)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(ends) - words])]
    return np.fromiter([hashed(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """One 64-bit word per lane: a bit is 1 where over half the hashes set it. Lanes after the first mix the hashes anew."""
    out = []
    for lane in range(lanes):
        h = hashes
        if lane:
            with np.errstate(over="ignore"):
                h = h ^ np.uint64(0x9E3779B97F4A7C15 * lane & (1 << 64) - 1)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
        counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _OFFSET).ravel(), minlength=2048) @ _BITS
        out.append(int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0)
    return out


def minima(hashes: np.ndarray) -> list[int]:
    """For each of MINIMA orders the shingle hash that comes first, with the order's number mixed in; an empty set has none."""
    if not len(hashes):
        return []
    with np.errstate(over="ignore"):
        least = ((hashes[:, None] ^ _ORDERS[0]) * _ORDERS[1]).min(axis=0)
        return ((least + np.arange(MINIMA, dtype=np.uint64)) * _ORDERS[0]).view(np.int64).tolist()


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1, distinct: bool = False, sets: bool = False) -> DataFrame:
    """(doc_id, n, bits): shingles, and `lanes` big-endian 64-bit words, of each row; null text counts as empty.

    With `distinct`, repeated shingles count once, `mark` is a digest of the set and `least` its minima; with `sets`, bits goes
    on with the set's hashes in order.
    """
    import xxhash

    schema = "doc_id long, n long, bits binary" + (", mark binary, least array<long>" if distinct else "")
    from pyspark.sql.types import StructType

    out = arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h = shingle_hashes(text, words)
                    h = np.unique(h) if distinct else h
                    bits = np.array(fingerprint(h, lanes), ">u8").tobytes()
                    whole = h.astype(">u8").tobytes() if distinct else b""
                    mark = (xxhash.xxh3_128_digest(whole), [] if sets else minima(h)) if distinct else ()
                    made.append((doc, len(h), bits + whole if sets else bits, *mark))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


class Forest:
    """Union-find over the rows of a task: of all links within it, a spanning forest goes on. root[k] is a smaller or equal
    row of k's tree, the same for all rows of a tree once settle() has run."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def settle(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the trees of i[k] and j[k], a link for each root at a time, until no link leads out of its tree."""
        while len(i):
            root = self.settle()
            low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            apart = low != high
            i, j, low, high = i[apart], j[apart], low[apart], high[apart]
            np.minimum.at(self.root, high, low)
        self.settle()


def tile_links(words: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, lead: int, forest: Forest) -> None:
    """Joins in the forest all rows of `left` and `right` (right None: of left alone) that differ in `radius` bits or fewer.

    Rows (n x lanes) come sorted by the bit count of all lanes. Block pairs whose bit counts lie further apart than the
    radius are skipped, and so are blocks whose rows are all of one tree. Of several lanes the first `lead` (at most 3) are
    counted together; only pairs that they leave within the radius see the others, so no pair within it is lost.
    """
    same = right is None
    right = left if same else right
    count = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    lanes = [np.ascontiguousarray(words[:, k]) for k in range(min(lead, words.shape[1], 3))]
    differ, bits, more = np.empty((BLOCK, 4 * BLOCK), np.uint64), np.empty((BLOCK, 4 * BLOCK), np.uint8), np.empty((BLOCK, 4 * BLOCK), np.uint8)
    for a in range(0, len(left), BLOCK):
        rows = left[a : a + BLOCK]
        start = np.searchsorted(count[right], count[rows[0]] - radius)
        stop = np.searchsorted(count[right], count[rows[-1]] + radius, "right")
        for b in range(max(start, a if same else 0), stop, 4 * BLOCK):
            others = right[b : min(b + 4 * BLOCK, stop)]
            one, two = forest.root[rows], forest.root[others]
            if one[0] == two[0] and (one == one[0]).all() and (two == one[0]).all():
                continue
            shape = (len(rows), len(others))
            d, n, m = (x[: shape[0], : shape[1]] for x in (differ, bits, more))
            for k, lane in enumerate(lanes):
                np.bitwise_xor(lane[rows][:, None], lane[others][None, :], out=d)
                np.bitwise_count(d, out=m if k else n)
                if k:
                    np.add(n, m, out=n)
            i, j = np.divmod(np.flatnonzero(n <= radius), shape[1])
            # Dense blocks in parts: the links of some rows join most of the rest, whose own then needn't be looked at.
            for at in range(0, len(i), 1 << 16):
                x, y = rows[i[at : at + (1 << 16)]], others[j[at : at + (1 << 16)]]
                apart = forest.root[x] != forest.root[y]
                x, y = x[apart], y[apart]
                if words.shape[1] > len(lanes) and len(x):
                    keep = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= radius
                    x, y = x[keep], y[keep]
                forest.join(x, y)


def set_links(words: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, radius: int, similarity: float, forest: Forest) -> None:
    """Joins in the forest all rows of `left` and `right` (right None: of left alone) whose fingerprints differ in `radius`
    bits or fewer and whose sets are alike in `similarity` (Jaccard) or more. Pairs of one tree needn't be looked at."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    code = [codes[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]
    held, root = np.zeros(len(codes) + 1, bool), forest.settle()
    for at, x in enumerate(left.tolist()):
        others = left[at + 1 :] if right is None else right
        others = others[root[others] != root[x]]
        others = others[np.minimum(size[others], size[x]) >= similarity * np.maximum(size[others], size[x]) - 0.5]
        others = others[np.bitwise_count(words[others] ^ words[x]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(others):
            continue
        held[code[x]] = True
        for y in others.tolist():
            if root[x] != root[y]:
                both = np.count_nonzero(held[code[y]])
                if both / (size[x] + size[y] - both) >= similarity:
                    low, high = sorted((root[x], root[y]))
                    root[root == high] = low
        held[code[x]] = False
    forest.root = root


def blocks_for(n: int, radius: int) -> int:
    """Bit blocks that a fingerprint is cut into: at least `radius` fewer agree whole, so more blocks make longer keys."""
    more = 1 + (n > 1 << 22) + (n > 1 << 30)
    return radius + more


def _cells_by_bits(nodes: DataFrame, blocks: int, radius: int) -> DataFrame:
    """Rows (cell, id, bits): near fingerprints share a cell, as differing bits leave blocks - radius of the blocks whole."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        masks.append(sum((1 << cuts[k + 1]) - (1 << cuts[k]) for k in chosen))
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    word = F.conv(F.hex(F.col("bits")), 16, -10).cast("long")
    cells = F.array(*(F.xxhash64(F.lit(k), F.col("word").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)))
    return nodes.withColumn("word", word).select(F.explode(cells).alias("cell"), "id", "bits", F.bit_count("word").alias("v"))


#: A size's logarithm in such steps orders the rows of a cell of sets.
STEP = 64


def _size(similarity: float):
    """The order of sets by size, and how far apart sets alike in `similarity` may lie in it."""
    return F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) * STEP).cast("int").alias("v"), math.ceil(STEP * math.log(1 / similarity)) + 1


def _cells_by_minima(nodes: DataFrame, similarity: float) -> DataFrame:
    """Rows (cell, id, bits, v): sets share a cell for each order in which the same shingle comes first."""
    return nodes.select(F.explode("least").alias("cell"), "id", "bits", _size(similarity)[0])


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _tiles(cells: DataFrame, tile: int, reach: int, folder: str, name: str, size_of: int | None = None) -> DataFrame:
    """Rows (pair, side, id, bits) from rows (cell, id, bits, v), of about `size_of` bytes: each tile pair that is to be compared
    gets the rows of both.

    A cell of up to `tile` rows is one tile; a row alone in its cell goes. The rows of a larger cell are ordered by v and cut
    into tiles, and only tile pairs whose ranges of v lie within `reach` of each other are made. A tile that meets itself has
    side 0 only.
    """
    size = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("total")).filter("total > 1")
    own = written(gathered(cells.join(size, "cell"), size_of), f"{name}-cells", folder)
    one = own.filter(F.col("total") <= tile).select(F.col("cell").alias("pair"), F.lit(0).alias("side"), "id", "bits")
    large = own.filter(F.col("total") > tile)
    if large.isEmpty():
        return one
    # A row for each cell and v, so a cell's window is as long as v has values.
    span = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    runs = large.groupBy("cell", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(span), F.lit(0)))
    runs = written(gathered(runs, size_of), f"{name}-runs", folder)
    ranges = runs.select("cell", "v", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("start") + F.col("n") - 1) / tile))).alias("t"))
    ranges = ranges.groupBy("cell", "t").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    other = ranges.select(F.col("cell").alias("c"), F.col("t").alias("u"), F.col("low").alias("low_u"))
    pairs = ranges.join(other, (F.col("cell") == F.col("c")) & (F.col("t") <= F.col("u")) & (F.col("low_u") - F.col("high") <= reach)).select("cell", "t", "u", F.xxhash64("cell", "t", "u").alias("pair"))
    pairs = written(gathered(pairs, size_of), f"{name}-pairs", folder)
    sides = pairs.select("cell", "t", "pair", F.lit(0).alias("side")).unionByName(pairs.filter("t < u").select("cell", F.col("u").alias("t"), "pair", F.lit(1).alias("side")))
    place = F.floor((F.col("start") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("n"))) / tile)
    placed = large.join(_small(runs), ["cell", "v"]).select("cell", place.alias("t"), "id", "bits")
    return one.unionByName(placed.join(_small(sides), ["cell", "t"]).select("pair", "side", "id", "bits"))


def _links(tiles: DataFrame, radius: int, lead: int, lanes: int = 0, similarity: float = 0.0) -> DataFrame:
    """Links (a, b) of ids: for each tile pair a spanning forest of the near fingerprints in it. With `lanes`, bits holds so
    many words and then the row's set, and only sets alike in `similarity` are linked."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(ids: np.ndarray, side: np.ndarray, cells: list[bytes]) -> Iterator[tuple[int, int]]:
        if len(ids) < 2:
            return
        words = np.frombuffer(b"".join(c[: 8 * lanes] for c in cells) if lanes else b"".join(cells), ">u8").astype("<u8").reshape(len(ids), -1)
        order = np.lexsort((ids, np.bitwise_count(words).sum(axis=1, dtype=np.int64)))
        ids, side, words = ids[order], side[order], words[order]
        forest, right = Forest(len(ids)), np.flatnonzero(side == 1)
        if lanes:
            sets = [np.frombuffer(cells[k], ">u8", offset=8 * lanes) for k in order.tolist()]
            set_links(words, sets, np.flatnonzero(side == 0), right if len(right) else None, radius, similarity, forest)
        else:
            tile_links(words, np.flatnonzero(side == 0), right if len(right) else None, radius, lead, forest)
        leaves = np.flatnonzero(forest.root != np.arange(len(ids)))
        yield from zip(ids[forest.root[leaves]].tolist(), ids[leaves].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair; a pair may span batches."""
        forget()
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table, whole: bool) -> tuple[list[tuple[int, int]], pa.Table | None]:
            pair = rows["pair"].to_numpy()
            edge = np.flatnonzero(np.diff(pair)) + 1
            stop = len(pair) if whole else (edge[-1] if len(edge) else 0)
            if not stop:
                return [], rows
            ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
            bits = rows["bits"].slice(0, int(stop)).to_pylist()
            made = []
            for a, b in zip([0, *edge[edge < stop].tolist()], [*edge[edge < stop].tolist(), int(stop)]):
                if b - a > 1:
                    made += compared(ids[a:b], side[a:b], bits[a:b])
            return made, rows.slice(stop) if stop < len(pair) else None

        for batch in batches:
            held.append(batch)
            made, rest = done(pa.Table.from_batches(held), False)
            held = rest.to_batches() if rest is not None else []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], schema=out)
        if held:
            made, _ = done(pa.Table.from_batches(held), True)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], schema=out)

    return tiles.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "a long, b long")


def bits_apart(both: int, one: int, other: int) -> float:
    """Chance that a bit differs in the fingerprints of sets with `both` shingles in common, and `one` and `other` of their own."""
    chance = lambda n: np.array([math.comb(n, k) / 2**n for k in range(n + 1)])
    shared, out = chance(both), 0.0
    for k, p in enumerate(shared):
        a = sum(q for i, q in enumerate(chance(one)) if 2 * (k + i) > both + one)
        b = sum(q for i, q in enumerate(chance(other)) if 2 * (k + i) > both + other)
        out += p * (a * (1 - b) + b * (1 - a))
    return out


def radius_of(similarity: float, lanes: int, deviations: float = 4.0) -> int:
    """Bits in which fingerprints of sets alike in `similarity` (Jaccard) or more differ, plus so many standard deviations. At
    4 and four lanes, of pairs at 0.8, 4e-08 of large sets and 1e-04 of the worst small ones differ in more (calculated). The share of bits is the angle between large sets, or the largest exact chance
    among sets of up to 24 shingles, which is above the angle."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    small = (bits_apart(c, a, b) for c in range(1, 25) for a in range(25 - c) for b in range(a, 25 - c) if 0 < a + b and c / (a + b + c) >= similarity)
    share, bits = max([share, *small]), 64 * lanes
    return int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def near_duplicates(docs: DataFrame, words: int = 4, lanes: int = 1, radius: int = 4, similarity: float | None = None, tile: int | None = None) -> DataFrame:
    """(doc_id, bits, n, component): bits is the fingerprint, component the smallest doc_id reachable through links.

    Rows are linked where their fingerprints differ in `radius` bits or fewer; equal fingerprints are compared once. Tiles
    of distinct fingerprints are compared exactly by exclusive-or and bit counts, and block pairs whose bit counts differ by
    more than the radius are skipped; tile pairs of a large cell whose bit counts, or set sizes, can't be those of a pair
    aren't made. Which fingerprints can meet at all is settled before: by whole bit blocks, which a pair within a small
    radius must share (no link is lost), or, with `similarity`, by the shingles that come first in MINIMA orders, of which
    a pair alike in s shares none with a chance of (1 - s) ** MINIMA. With `similarity` a link within the radius is proposed
    only: shingles count once, and within each component of proposals the links are confirmed by the shingle sets (of 64-bit
    hashes), Jaccard `similarity` or more. Cells of any size are dealt to tiles, so none lands in one task. A task hands on
    a spanning forest of its links, never all pairs. Null doc_id: the row is no one's smallest but keeps its group's
    component (null if all are null). Repeated rows: all are kept. Empty table: empty result.
    """
    folder = shared_dir(docs.sparkSession)
    exact = similarity is not None
    marks = written(fingerprints(docs, words, lanes, distinct=exact), "marks", folder)
    keys = ["mark"] if exact else ["bits"]
    more = [F.first(c).alias(c) for c in ("bits", "n", "least") if exact]
    row = ROW + WORD * (lanes + MINIMA * exact)
    rows = marks.count()
    nodes = written(gathered(marks.groupBy(*keys).agg(F.min("doc_id").alias("id"), *more).filter("id is not null"), row * rows), "nodes", folder)
    number = nodes.count()
    tile = tile or min(TILE[1], max(TILE[0], int(8 * math.sqrt(number))))
    cells = _cells_by_minima(nodes, similarity) if exact else _cells_by_bits(nodes, blocks_for(number, radius), radius)
    many = number * (MINIMA if exact else math.comb(blocks_for(number, radius), radius))
    tiles = _tiles(cells, tile, _size(similarity)[1] if exact else radius, folder, "near", (ROW + WORD * lanes) * many)
    found = components(_links(tiles, radius, 3), most=many)
    if exact:
        found = components(_confirmed(docs, nodes, found, words, lanes, radius, similarity), most=number)
    found = nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select(*keys, F.coalesce("component", "id").alias("component"))
    return gathered(marks.join(found, keys, "left").select("doc_id", "bits", "n", "component"), row * rows)


def _confirmed(docs: DataFrame, nodes: DataFrame, proposed: DataFrame, words: int, lanes: int, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) within the proposed components whose shingle sets are alike in `similarity`; sets are built anew, for the
    components' rows alone."""
    folder = shared_dir(docs.sparkSession)
    members = nodes.join(proposed.withColumnRenamed("node", "id"), "id").select("id", "n", "mark", "component")
    members = written(gathered(members, ROW * nodes.count()), "members", folder)
    ids = members.select("id").distinct()
    number, hashes = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ids = F.broadcast(ids) if number <= BROADCAST_ROWS else ids
    size = ROW * number + WORD * (lanes * number + hashes)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sets = fingerprints(own, words, lanes, distinct=True, sets=True).select(F.col("doc_id").alias("id"), "mark", "bits")
    sets = written(gathered(sets.join(members, ["id", "mark"]).dropDuplicates(["id", "mark"]), size), "sets", folder)
    v, reach = _size(similarity)
    cells = sets.select(F.col("component").alias("cell"), "id", "bits", v)
    return _links(_tiles(cells, SETS, reach, folder, "sets", size), radius, 3, lanes, similarity)


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5, lanes: int = 4) -> DataFrame:
    """The rows of docs, all columns, that no near-duplicate of smaller doc_id precedes; of rows with one doc_id, all or none.

    Near means a similarity of shingle sets of `similarity` or more; fingerprints of lanes x 64 bits propose the pairs.
    """
    found = near_duplicates(docs, words, lanes, radius_of(similarity, lanes), similarity)
    gone = found.filter("doc_id is not null and component is not null and doc_id <> component").select(F.col("doc_id").alias("gone_doc_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_doc_id"], "left_anti")
