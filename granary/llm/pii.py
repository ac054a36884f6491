"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, arrow_map, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\s,;:!?\"'<>\[\]{}|]+")
_MARK = re.compile("[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern. Every match has one @ right after its local part, so each @ is tried once,
    from the longest local part before it: time grows with the text, not with its square."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans in order; leftmost non-overlapping within a kind. Offsets count code points."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        # A part of many digits is over 255 whatever they are, but for leading zeros.
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- the field -------------------------------------------------------------------------------------------------------
#: Labels: 0 is no personal data, then KINDS.
LABELS = 1 + len(KINDS)
FEATURES = 14


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that the field labels: those with a digit or an @, without marks at their ends."""
    out = []
    for m in _TOKEN.finditer(text):
        if not _MARK.search(m[0]):
            continue
        a, b = m.span()
        while a < b and text[a] in "().-":
            a += 1
        while b > a and text[b - 1] in "().-%":
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def features(token: str) -> list[float]:
    digits = sum(c.isdigit() for c in token)
    n = len(token)
    return [1.0, float("@" in token), float("@" in token and "." in token.rpartition("@")[2]), digits / n, float(digits == n), float(digits >= 5), float(9 <= digits <= 15), float(12 <= digits <= 19), float(token.count(".") == 3), float(token[0] == "+"), float("-" in token), float(any(c.isalpha() for c in token)), float(n <= 4), float(_luhn(_digits(token)[:40]) if digits > 11 else 0)]


def possible(token: str) -> list[bool]:
    """Labels that a token may have at all: an email holds an @, an address four digits and three marks between, a card 12
    digits, a phone number 7."""
    digits = len(_digits(token))
    return [True, "@" in token, digits >= 4 and sum(c in ".:-_" for c in token) >= 3, digits >= 12, digits >= 7]


def same_key(token: str) -> str:
    """Tokens with one key are taken for the same: letters in one case, and of mostly digits the digits alone."""
    digits = _digits(token)
    return digits if len(digits) >= 6 and len(digits) >= len(token) // 2 else token.casefold()


class Field:
    """Weights of the field: unary (FEATURES x LABELS), chain and skip potentials (LABELS x LABELS), all logarithms."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, x: np.ndarray, observed: list[int | None], edges: list[tuple[int, int, int]], rounds: int = 200, can: np.ndarray | None = None) -> np.ndarray:
        """Loopy belief propagation: edges are (i, j, 0 chain or 1 skip). Observed nodes keep their label, others get none
        that `can` rules out. Messages are damped by half, so that loops settle, and go on until they change no more; on a
        tree the result is exact once they have crossed it."""
        local = x @ self.unary
        if can is not None:
            local = np.where(can, local, -30.0)
        for k, y in enumerate(observed):
            if y is not None:
                local[k] = -30.0
                local[k, y] = 0.0
        if edges:
            i, j, kind = (np.array(c) for c in zip(*edges))
            source, target = np.concatenate([i, j]), np.concatenate([j, i])
            forward = np.stack([self.chain, self.skip])[kind]
            table = np.concatenate([forward, forward.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
            message = np.zeros((2 * len(i), LABELS))
            for _ in range(rounds):
                total = local.copy()
                np.add.at(total, target, message)
                out = total[source] - message[back]
                new = np.logaddexp.reduce(out[:, :, None] + table, axis=1)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                step = np.abs(new - message).max()
                message = (message + new) / 2
                if step < 1e-3:
                    break
            np.add.at(local, target, message)
        local -= np.logaddexp.reduce(local, axis=1, keepdims=True)
        return np.exp(local)


def graph(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Chain edges between candidates at most 40 characters apart; skip edges from each token to the next with its key,
    so that a token of n places adds n - 1 edges."""
    edges, last = [], {}
    for k, (a, b) in enumerate(tokens):
        if k and a - tokens[k - 1][1] <= 40:
            edges.append((k - 1, k, 0))
        key = same_key(text[a:b])
        if key in last:
            edges.append((last[key], k, 1))
        last[key] = k
    return edges


def covered(tokens: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int | None]:
    """The label of each token that lies in a base span, else None. Of several kinds the first listed one counts. Tokens come
    in order, and spans of one kind don't overlap, so each is passed once."""
    out: list[int | None] = [None] * len(tokens)
    for kind in reversed(range(len(KINDS))):
        spans, at = sorted((a, b) for a, k, b in base if k == kind), 0
        for n, (a, b) in enumerate(tokens) if spans else ():
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            if at < len(spans) and spans[at][0] < b:
                out[n] = 1 + kind
    return out


def additional(text: str, base: list[tuple[int, int, int]], field: Field, sure: float = 0.9) -> list[tuple[int, int, int]]:
    """Spans that the field adds: tokens outside the base spans whose most likely label is a kind, with `sure` or more."""
    tokens = candidates(text)
    observed = covered(tokens, base)
    if all(y is not None for y in observed):
        return []
    edges, names = graph(text, tokens), [text[a:b] for a, b in tokens]
    marginal = field.marginals(np.array(list(map(features, names))), observed, edges, can=np.array(list(map(possible, names))))
    return [(a, int(m.argmax()) - 1, b) for (a, b), y, m in zip(tokens, observed, marginal) if y is None and m.argmax() and m.max() >= sure]


def neighbours(labels: list[int], edges: list[tuple[int, int, int]]) -> np.ndarray:
    """For each token how many of its neighbours have each label: by chain, then by skip edges."""
    out = np.zeros((len(labels), 2 * LABELS))
    for i, j, kind in edges:
        out[i, LABELS * kind + labels[j]] += 1
        out[j, LABELS * kind + labels[i]] += 1
    return out


def fit(docs: DataFrame, looked: int = 80_000, tokens: int = 40_000, steps: int = 400) -> Field:
    """Trains the field on what the base patterns label: about `looked` documents are drawn by a hash of their text, and of
    the tokens of those that hold base spans, wherever they stand, the `tokens` with the least hashes are learned from.

    All potentials are fitted together, by the pseudo-likelihood of each token's label given its neighbours'. As the labels
    follow from what a token looks like, half of the tokens show their neighbours only, so that these count too. A token
    outside all base spans with the key of one inside isn't learned from: it is what the field is to find. A corpus
    without personal data gives a field that adds nothing.
    """

    def rows(c: dict) -> Iterator[tuple]:
        for text in c["text"]:
            if base := find(text):
                found = candidates(text)
                known = covered(found, base)
                keys = [same_key(text[a:b]) for a, b in found]
                inside = {k for k, y in zip(keys, known) if y}
                labels, edges = [y or 0 for y in known], graph(text, found)
                near, seed = neighbours(labels, edges), hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                for i, (a, b) in enumerate(found):
                    if labels[i] or keys[i] not in inside:
                        tie = int.from_bytes(hashlib.blake2b(seed + i.to_bytes(8, "big"), digest_size=7).digest(), "big")
                        yield tie, [labels[i], *features(text[a:b]), *near[i].tolist()]

    share = looked / max(looked, docs.count())
    drawn = docs.select(text_of().alias("text")).filter((F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 20)) / (1 << 20)) < share)
    found = arrow_map(drawn, rows, "tie long, token array<double>").orderBy("tie", "token").limit(tokens).collect()
    w = np.zeros((FEATURES + 2 * LABELS, LABELS))
    w[0, 0] = 4.0
    if found:
        data = np.array([r.token for r in found])
        y, x = data[:, 0].astype(int), data[:, 1:]
        x[::2, 1:FEATURES] = 0.0
        hot, moment = np.eye(LABELS)[y], np.zeros_like(w)
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
            moment = 0.9 * moment + x.T @ (hot - p) / len(x) - 1e-4 * w
            w += 0.2 * moment
    chain, skip = w[FEATURES : FEATURES + LABELS], w[FEATURES + LABELS :]
    return Field(w[:FEATURES], (chain + chain.T) / 2, (skip + skip.T) / 2)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs.

    Base spans come from the patterns, further ones from the field, which is trained on docs unless given. Null text counts
    as empty; repeated rows are each scanned; an empty table gives an empty result.
    """
    spread = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    def rows(c: dict) -> Iterator[tuple]:
        for doc, text in zip(c["doc_id"], c["text"]):
            base = find(text)
            count = defaultdict(int)
            for _, k, _ in base:
                count[k] += 1
            more = additional(text, base, spread.value)
            yield doc, count[0], count[1], count[2], count[3], hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one, of the first's kind."""
    out, end = [], 0
    for a, k, b in sorted(spans):
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs, all columns, with personal data in `text` masked, and n_chars, where there is one, counted anew. Null texts stay null."""
    spread = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                k = part.schema.names.index("text")
                texts = []
                for text in part.column(k).to_pylist():
                    base = find(text) if text else []
                    texts.append(masked(text, base + additional(text, base, spread.value)) if text else text)
                columns = list(part.columns)
                columns[k] = pa.array(texts, part.schema.field(k).type)
                if "n_chars" in part.schema.names:
                    n = part.schema.names.index("n_chars")
                    columns[n] = pa.array([old if new is None else len(new) for old, new in zip(columns[n].to_pylist(), texts)], part.schema.field(n).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
