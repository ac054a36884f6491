"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, shared_dir, text_of, written
from .tokens import encoder

#: Pieces that one shard holds; bounds an island's memory. The number of shards grows with the input.
ISLAND = 65_536
POPULATION, GENERATIONS, ISLANDS, ROUNDS = 5, 12, 3, 2
#: Bins of a child whose documents may give way to displaced ones that fill the bin better, and displaced ones looked at.
TRIES, DISPLACED = 128, 256
#: Bins filled below this share are packed again with those of other shards.
ROOMY = 0.97

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of each document: its ids and end_id, cut into `capacity` ids where it is longer.

    Null text: empty, which is one piece holding the end id. Null or repeated doc_id: rows are kept as they are.
    """

    from pyspark.sql.types import StructType

    out = arrow_schema(StructType.fromDDL(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, size = end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part, rows = batch.slice(at, 2048), []
                for doc, ids in zip(part.column(0).to_pylist(), encoder(path).encode(part.column(1))):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), size)):
                        cut = ids[start : start + size]
                        rows.append((doc, piece, start // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES)


class Bins:
    """Bins of one capacity, found by their free space: an integer's bits tell which free spaces occur.

    items: the documents of each bin; used: how full it is. Lists taken from another packing are copied when they change.
    """

    def __init__(self, capacity: int):
        self.capacity, self.free, self.mask = capacity, [[] for _ in range(capacity + 1)], 0
        self.items: list[list[int]] = []
        self.used: list[int] = []

    def add(self, items: list[int], used: int) -> None:
        free = self.capacity - used
        self.free[free].append(len(self.items))
        self.mask |= 1 << free
        self.items.append(items)
        self.used.append(used)

    def best_fit(self, item: int, length: int) -> None:
        """Into the bin with the least free space that suffices, or a new one."""
        fits = self.mask >> length
        if not fits:
            return self.add([item], length)
        free = length + (fits & -fits).bit_length() - 1
        at = self.free[free]
        number = at.pop()
        if not at:
            self.mask &= ~(1 << free)
        free -= length
        self.items[number] = [*self.items[number], item]
        self.used[number] += length
        self.free[free].append(number)
        self.mask |= 1 << free


def decreasing(items, length: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    bins = bins or Bins(capacity)
    for i in sorted(items, key=lambda i: -length[i]):
        bins.best_fit(i, length[i])
    return bins


def fitness(packing: Bins) -> tuple[int, float]:
    """Fewer bins first; then bins filled as unevenly as possible, which leaves room to empty one."""
    return -len(packing.items), sum(u * u for u in packing.used) / packing.capacity**2


def exchange(kept: list[tuple[list[int], int]], loose: list[int], length: list[int], capacity: int, rng: random.Random) -> None:
    """In bins at random, a document gives way to one or two displaced ones that leave less room; changes both lists. What is
    displaced then is smaller, and fits better elsewhere."""
    if not loose or not kept:
        return
    rng.shuffle(loose)
    pool = sorted((length[i], i) for i in loose[:DISPLACED])
    rest = loose[DISPLACED:]
    for k in rng.sample(range(len(kept)), min(TRIES, len(kept))):
        items, used = kept[k]
        if used == capacity:
            continue
        best, gone, taken = 0, None, ()
        for i in {length[i]: i for i in items}.values():
            room = length[i] + capacity - used
            high = bisect.bisect_right(pool, (room, len(length))) - 1
            if high >= 0 and pool[high][0] - length[i] > best:
                best, gone, taken = pool[high][0] - length[i], i, (high,)
            low = 0
            while low < high:
                both = pool[low][0] + pool[high][0]
                if both > room:
                    high -= 1
                    continue
                if both - length[i] > best:
                    best, gone, taken = both - length[i], i, (low, high)
                low += 1
        if gone is not None:
            new = [pool[t][1] for t in taken]
            for t in reversed(taken):
                del pool[t]
            at = items.index(gone)
            kept[k] = [*items[:at], *items[at + 1 :], *new], used + best
            bisect.insort(pool, (length[gone], gone))
    loose[:] = [i for _, i in pool] + rest


def cross(one: Bins, other: Bins, length: list[int], rng: random.Random) -> Bins:
    """Whole well-filled bins of `other` are injected into `one`; bins of `one` that hold a duplicate give way, and the
    documents they displace go by best fit."""
    filled = sorted(range(len(other.items)), key=lambda k: -other.used[k])
    at = rng.randrange(max(1, len(filled) // 2))
    injected = filled[at : at + max(1, len(filled) // 20)]
    taken = {i for k in injected for i in other.items[k]}
    kept, displaced = [(other.items[k], other.used[k]) for k in injected], []
    for b, u in zip(one.items, one.used):
        if taken.isdisjoint(b):
            kept.append((b, u))
        else:
            displaced += [i for i in b if i not in taken]
    exchange(kept, displaced, length, one.capacity, rng)
    return decreasing(displaced, length, one.capacity, filled_with(kept, one.capacity))


def filled_with(kept: list[tuple[list[int], int]], capacity: int) -> Bins:
    bins = Bins(capacity)
    for b, u in kept:
        bins.add(b, u)
    return bins


def mutate(packing: Bins, length: list[int], rng: random.Random) -> Bins:
    """The emptiest bins and some at random are undone; their documents change places with others and go by best fit in
    another order."""
    few = max(1, len(packing.items) // 100)
    undone = {*sorted(range(len(packing.items)), key=packing.used.__getitem__)[:few], *rng.sample(range(len(packing.items)), few)}
    kept = [(b, u) for k, (b, u) in enumerate(zip(packing.items, packing.used)) if k not in undone]
    loose = [i for k in sorted(undone) for i in packing.items[k]]
    exchange(kept, loose, length, packing.capacity, rng)
    bins = filled_with(kept, packing.capacity)
    for _, i in sorted((-length[i] * rng.uniform(0.8, 1.2), i) for i in loose):
        bins.best_fit(i, length[i])
    return bins


def evolve(length: list[int], capacity: int, seed: int, first: list[list[list[int]]] = (), population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
    """The best packing that one island finds; `first` are the bins of parents. Ends at the lower bound, which no packing beats."""
    rng, bound, people = random.Random(seed), -(-sum(length) // capacity), []
    for parent in first:
        people.append(Bins(capacity))
        for b in parent:
            people[-1].add(b, sum(length[i] for i in b))
    people = people or [decreasing(range(len(length)), length, capacity)]
    if generations:
        while len(people) < population and len(people[0].items) > bound:
            people.append(mutate(people[0], length, rng))
    ranked = sorted(people, key=fitness, reverse=True)
    for _ in range(generations):
        if len(ranked[0].items) <= bound:
            break
        child = cross(ranked[0], ranked[rng.randrange(1, len(ranked))], length, rng)
        ranked = sorted([*ranked, child, mutate(child, length, rng)], key=fitness, reverse=True)[:population]
    return ranked[0]


STATE = "shard long, island int, guest int, doc_id long, piece int, start long, length long, ids_crc32 long, tie long, bin long, offset long, used long, bins long, fit double"


def _evolved(state: DataFrame, keys: list[str], capacity: int, seed: int, generations: int) -> DataFrame:
    """Each group of `keys` evolved: its own packing (guest 0) and an immigrant (guest 1) are its first parents, where
    they are there. Rows get bin, the place within it, the bin's fill, the number of bins and the fitness."""
    from pyspark.sql.types import StructType

    out = arrow_schema(StructType.fromDDL(STATE))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("guest", "doc_id", "piece", "ids_crc32", "tie")])  # alike however rows arrive
        first = []
        guests = t["guest"].to_pylist()
        n = guests.index(1) if 1 in guests else len(guests)
        for part in (t.slice(0, n), t.slice(n)):
            groups: dict[int, list[int]] = {}
            for i, b in enumerate(part["bin"].to_pylist()):
                if b is not None:
                    groups.setdefault(b, []).append(i)
            if groups:
                first.append(list(groups.values()))
        t = t.slice(0, n)
        length = t["length"].to_pylist()
        best = evolve(length, capacity, seed + 1009 * t["shard"][0].as_py() + t["island"][0].as_py(), first, generations=generations)
        number, place, used = [0] * n, [0] * n, [0] * n
        for k, (b, u) in enumerate(zip(best.items, best.used)):
            at = 0
            for i in sorted(b):
                number[i], place[i], used[i] = k, at, u
                at += length[i]
        fit = fitness(best)[1]
        made = {"bin": number, "offset": place, "used": used, "bins": [len(best.items)] * n, "fit": [fit] * n, "guest": [0] * n}
        return pa.Table.from_arrays([pa.array(made[f.name], f.type) if f.name in made else t[f.name].combine_chunks().cast(f.type) for f in out], schema=out)

    return state.groupBy(*keys).applyInArrow(run, STATE)


def _packed(rows: DataFrame, shards: int, capacity: int, folder: str, name: str, islands: int, rounds: int) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, tie) dealt to shards by hash, each packed by its ring of islands."""
    none = {"island": F.lit(0), "guest": F.lit(0), "bin": F.lit(None).cast("long"), "offset": F.lit(0).cast("long"), "used": F.lit(0).cast("long"), "bins": F.lit(0).cast("long"), "fit": F.lit(0.0)}
    state = rows.withColumns({"shard": F.pmod(F.xxhash64("doc_id", "piece", "tie", F.lit(name)), F.lit(shards)), **none}).select(*(x.split()[0] for x in STATE.split(", ")))
    start = written(_evolved(state, ["shard"], capacity, 0, 0), f"{name}-start", folder)
    bound = start.groupBy("shard").agg(F.ceil(F.sum("length") / capacity).alias("bound"), F.max("bins").alias("have")).filter("have > bound").select("shard")
    unsolved = start.join(bound, "shard", "left_semi")
    if rounds < 1 or unsolved.isEmpty():
        return start
    state = unsolved.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    for r in range(rounds):
        state = written(_evolved(state.select(*start.columns), ["shard", "island"], capacity, 31 * r + 1, GENERATIONS), f"{name}-round{r}", folder)
        # The elite of each island migrates to the next one of its ring.
        elite = state.withColumns({"island": F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"), "guest": F.lit(1)})
        best = state
        state = state.unionByName(elite)
    rank = best.groupBy("shard").agg(F.min(F.struct("bins", (-F.col("fit")).alias("f"), "island"))["island"].alias("island"))
    best = best.join(rank, ["shard", "island"], "left_semi")
    return start.join(bound, "shard", "left_anti").unionByName(best.select(*start.columns))


def pack(cut: DataFrame, capacity: int = 2048, shard: int = ISLAND, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """Packs pieces (PIECES) into sequences of at most `capacity`: their columns, sequence_id and offset.

    Pieces are dealt by hash to shards of about `shard` pieces, so no document, source or length can fill one. Each shard
    starts from best-fit decreasing; one that misses its lower bound is evolved by a ring of `islands` populations, which
    send their elite on after each round. At last the bins with room left of all shards are undone and packed together in
    the same way. Every piece is in the result once. Empty table: empty result. Pieces alike in all columns are told
    apart by a tie number.
    """
    folder = shared_dir(cut.sparkSession)
    rows = written(cut.withColumn("tie", F.monotonically_increasing_id()), "pieces", folder)
    shards = max(1, -(-rows.count() // shard))
    columns = [*cut.columns, "sequence_id", "offset"]
    number = lambda k: (F.lit(k << 60) + F.col("shard") * (1 << 24) + F.col("bin")).alias("sequence_id")
    first = _packed(rows, shards, capacity, folder, "first", islands, rounds)
    if shards == 1:
        return first.select(*cut.columns, number(0), "offset")
    first = written(first, "first", folder)
    roomy = F.col("used") < ROOMY * capacity
    left = first.filter(roomy).select(*rows.columns)
    fewer = max(1, -(-left.count() // shard))
    again = _packed(left, fewer, capacity, folder, "second", islands, rounds)
    return first.filter(~roomy).select(*cut.columns, number(0), "offset").unionByName(again.select(*cut.columns, number(1), "offset")).select(*columns)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """pieces() and pack() in one."""
    return pack(pieces(docs, path, capacity, end_id), capacity)
