"""The whole job of the learned and hashed stages, against plain Python."""

import numpy as np

from granary.llm import simhash


def _shingles(text, words=5):
    w = text.lower().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _kept(texts, similarity=0.8):
    """The smallest doc_id of each component of pairs alike in `similarity`, by brute force."""
    up = {d: d for d, _ in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, t) in enumerate(texts):
        for e, u in texts[:i]:
            if _jaccard(t, u) >= similarity:
                up[max(root(d), root(e))] = min(root(d), root(e))
    return [d for d in sorted(up) if root(d) == d]


def _keep_one(spark, texts):
    return sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect())


def test_near_pairs_are_those_of_the_shingle_sets(spark):
    """Pairs of one template from 0.55 to 0.95, long and short: all at 0.8 or more are linked, and none below."""
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    texts, near = [], 0
    for k in range(160):
        n = int(rng.integers(8, 14)) if k % 4 == 0 else int(rng.integers(60, 400))
        base, share = words(n), rng.uniform(0.55, 0.95)
        cut = max(1, round(n * (1 - share) / (1 + share)))
        other = base[:-cut] + words(cut)
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        near += _jaccard(texts[-1][1], texts[-2][1]) >= 0.8
    assert 30 < near < 130
    assert _keep_one(spark, texts) == sorted(d for k in range(160) for d in _kept(texts[2 * k : 2 * k + 2]))


def test_near_groups_across_tiles_of_sets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 8)
    rng = np.random.default_rng(7)
    base, texts = [f"w{x}" for x in range(120)], []
    for k in range(60):
        t = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, 5))):
            t[int(at)] = f"x{rng.integers(0, 3)}"
        texts.append((k, " ".join(t)))
    assert _keep_one(spark, texts) == _kept(texts)


def test_repeated_shingles_count_once(spark):
    """A text, the text twice, and the text with one line many times: near copies, however their counts differ."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(12):
        t = [f"w{x}" for x in rng.integers(0, 50_000, 200)]
        texts += [(10 * k, " ".join(t)), (10 * k + 1, " ".join(t + t)), (10 * k + 2, " ".join(t + t[:9] * 60))]
    assert _kept(texts) == [10 * k for k in range(12)]
    assert _keep_one(spark, texts) == _kept(texts)


def test_lanes_are_counted_together():
    """A pair within the radius is linked, however its differing bits lie among the lanes."""
    for far in ((40, 0, 0, 0), (25, 10, 5, 0), (0, 0, 0, 40), (10, 10, 10, 10), (41, 0, 0, 0), (0, 0, 0, 41)):
        words = np.zeros((2, 4), np.uint64)
        words[1] = [(1 << n) - 1 for n in far]
        forest = simhash.Forest(2)
        simhash.tile_links(words, np.arange(2), None, 40, 3, forest)
        assert (forest.root[1] == 0) == (sum(far) <= 40)
