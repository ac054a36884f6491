"""Tokenizers of the public tokenizers library with a bounded memory of the parts that each worker has met.

Texts are cut by the classes of their characters as the tokenizer's own pre-tokenizer does, and each distinct part of a
slice is looked up once; parts never met are merged by the library's model, many in one call. Parts, their ids and the
memory are Arrow arrays, so that no part becomes an object of its own. The result equals encoding the whole text at once
(tests hold the two against each other).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts, and bytes of them and their ids, that a worker remembers at most; longer parts (bytes) aren't remembered. Results
#: depend on none of these.
CACHE, CACHE_BYTES, LONGEST = 500_000, 48 << 20, 64
#: Bytes of text that are encoded at once; a single longer text goes alone.
SLICE_BYTES = 8 << 20

# Fixed value: the spaces of the Unicode property White_Space beyond ASCII.
_WIDE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Texts that hold anything the classes below can't treat alike are cut by themselves. Runs of spaces are such a thing for
#: byte-level BPE; composition and the context of lower case are for the other.
_HARD_BYTES = rf"[ \t-\r][ \t-\r]|[\x1c-\x1f{_WIDE}]"
_SIMPLE = "\\x{00}-\\x{1b}\\x{20}-\\x{84}\\x{a1}-\\x{12f}\\x{131}-\\x{24f}\\x{400}-\\x{45f}\\x{2010}-\\x{2027}\\x{2030}-\\x{205e}\\x{3041}-\\x{3096}\\x{30a1}-\\x{30fa}\\x{4e00}-\\x{9fff}"
_HARD_WORDS = f"[^{_SIMPLE}]"

#: Classes of characters; a table of them for ASCII, and one for all code points that is filled as they are met.
_MARK, _LETTER, _NUMBER, _BLANK, _BREAK, _UNKNOWN = range(6)
_ASCII = np.array([_LETTER if chr(b).isalpha() else _NUMBER if chr(b).isdigit() else _BLANK if b == 32 else _BREAK if 9 <= b <= 13 else _MARK for b in range(128)] + [_MARK] * 128, np.uint8)
_points: list[np.ndarray] = []

#: Before a piece that the library is to cut itself; no byte of UTF-8.
_WHOLE = b"\xfe"

#: Byte-level BPE writes bytes that don't print as the characters from U+0100 up, in order. 0xFF, no byte of UTF-8, parts parts.
_PRINT = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = np.arange(256, dtype="<u4")
_BYTES[[b for b in range(256) if b not in _PRINT]] = 256 + np.arange(256 - len(_PRINT))
_BYTES[0xFF] = 32

_made: dict[str, "Encoder"] = {}


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    out = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    if not _points:
        _points.append(np.full(0x110000, _UNKNOWN, np.uint8))
    known, first = _points[0], data[lead]
    point = np.where(first < 0xE0, first & 0x1F, np.where(first < 0xF0, first & 0x0F, first & 0x07)).astype(np.uint32)
    places = [lead, lead + 1]
    point = point << 6 | data[lead + 1] & 0x3F
    for k, least in ((2, 0xE0), (3, 0xF0)):
        longer = np.flatnonzero(first >= least)
        places.append(lead[longer] + k)
        point[longer] = point[longer] << 6 | data[places[k]] & 0x3F
    new = np.unique(point[known[point] == _UNKNOWN])
    if len(new):
        from tokenizers import Regex, normalizers

        # The library is asked, as others know another version of Unicode.
        chars = "".join(map(chr, new.tolist()))
        known[new] = _MARK
        for pattern, what in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER)):
            turned = normalizers.Replace(Regex(pattern), "x").normalize_str(chars)
            known[new[np.frombuffer(turned.encode("utf-32-le"), "<u4") == ord("x")]] = what
    kind = known[point]
    for k, at in enumerate(places):
        out[at] = kind if k < 2 else kind[first >= (0xE0, 0xF0)[k - 2]]
    return out


def _cut_easy(texts: pa.LargeStringArray, words: bool) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Parts of texts that aren't hard, and the place of each text's first one; words: parts begin with the space before."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    if offsets[0] == offsets[-1]:
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    body = body.slice(offsets[0], offsets[-1] - offsets[0])
    data, starts = np.frombuffer(body, np.uint8), offsets - offsets[0]
    kind = _classes(data)
    if words:
        kind[kind == _BREAK] = _BLANK
    fresh = np.empty(len(data) + 1, bool)  # where what stands before is of another class
    fresh[0] = fresh[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:-1])
    fresh[starts] = True
    begins = fresh.copy()
    begins[1:-1] &= kind[:-1] != _BLANK  # a space belongs to what follows
    if words:
        begins[:-1] |= (kind == _NUMBER) & (data & 0xC0 != 0x80)  # each digit is a part, unless a space went before
        begins[1:-1] &= kind[:-1] != _BLANK
    begins[starts] = True
    quotes = np.flatnonzero((data == 39) & (fresh if words else begins)[:-1])
    if len(quotes):
        # Suffixes within the text: a quote, then one letter of these or two.
        left = starts[np.searchsorted(starts, quotes, "right")] - quotes
        one, two = (np.where(left > k, data[np.minimum(quotes + k, len(data) - 1)], 0) for k in (1, 2))
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
        begins[quotes[short | long] + 1] = False
        begins[quotes[short] + 2] = True
        begins[quotes[long] + 3] = True
    places = np.flatnonzero(begins)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), body]), np.searchsorted(places, starts)


class Encoder:
    """encode(texts) gives for each text its ids as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = "Lowercase" in repr(self.tokenizer.normalizer)
        self.inner = self.tokenizer.pre_tokenizer
        #: The same model over parts that are cut already.
        self.parted = Tokenizer(self.tokenizer.model)
        self.parted.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.parted.model._resize_cache(0)  # parts are remembered here
        #: Bytes of text that each token stands for.
        vocab, suffix = self.parted.get_vocab(), self.parted.model.end_of_word_suffix or ""
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, k in vocab.items():
            self.bytes_of[k] = len(token.removesuffix(suffix))
        self.forget()

    def forget(self) -> None:
        #: Parts, the packed ids of each, and how often it was seen, old sightings counting less.
        self.parts, self.packed, self.seen = pa.array([], pa.large_binary()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What the model merges within, and where each text's parts begin and end; some are empty or but space."""
        hard = pc.match_substring_regex(texts, _HARD_WORDS if self.words else _HARD_BYTES).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(hard), "", texts) if hard.any() else texts
        values, starts = _cut_easy(pc.utf8_lower(plain) if self.words else plain, self.words)
        begin, end = starts[:-1], starts[1:]
        if hard.any():
            own = texts.filter(pa.array(hard)).to_pylist()
            # The library normalises pieces between ASCII spaces itself; they are cut there alone.
            own = [[_WHOLE + x for x in text.encode().split()] if self.words else [text[a:b].encode() for _, (a, b) in self.inner.pre_tokenize_str(text)] for text in own]
            places = len(values) + np.cumsum([0, *map(len, own)])
            begin, end = begin.copy(), end.copy()
            begin[hard], end[hard] = places[:-1], places[1:]
            values = pa.concat_arrays([values, pa.array([x for f in own for x in f], pa.large_binary())])
        return values, begin, end

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string())
        out: list[bytes] = []
        for part in _slices(texts):
            values, begin, end = self.cut(part)
            coded = values.dictionary_encode()
            found = self._ids(coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))).take(coded.indices)
            ends, data = _ends(found), memoryview(found.buffers()[2] or b"")
            out += [data[a:b].tobytes() for a, b in zip(ends[begin].tolist(), ends[end].tolist())]
        return out

    def _ids(self, parts: pa.Array, seen: np.ndarray) -> pa.Array:
        """Packed ids of each distinct part; those never met go to the library's model together."""
        place = pc.index_in(parts, value_set=self.parts)
        missing = place.is_null()
        place = place.fill_null(0).to_numpy()
        lost = missing.to_numpy(zero_copy_only=False)
        new = parts.filter(missing)
        made = self._new(new)
        place = np.where(lost, len(self.parts) + np.cumsum(lost) - 1, place)
        packed = pa.concat_arrays([self.packed, made])
        ids = packed.take(pa.array(place))
        # The memory: parts known and new; when it is full, the rarer half goes, and what counts as rare is halved.
        self.parts, self.packed, self.seen = pa.concat_arrays([self.parts, new]), packed, np.append(self.seen, np.zeros(len(new), np.int64))
        self.seen[place] += seen
        keep = pc.less_equal(pc.binary_length(self.parts), LONGEST).to_numpy(zero_copy_only=False)
        if len(keep) > CACHE or self.parts.nbytes + self.packed.nbytes > CACHE_BYTES:
            half = max(1, min(len(keep), CACHE) // 2)
            keep &= self.seen > np.partition(self.seen, -half)[-half]
            self.seen //= 2
        if not keep.all():
            self.parts, self.packed, self.seen = self.parts.filter(pa.array(keep)), self.packed.filter(pa.array(keep)), self.seen[keep]
        return ids

    def _new(self, parts: pa.Array) -> pa.Array:
        if not self.words:
            return self._merged(parts)
        whole = pc.starts_with(parts, _WHOLE).to_numpy(zero_copy_only=False)
        made = self._merged(pc.ascii_trim_whitespace(parts.filter(pa.array(~whole)).cast(pa.large_string())).cast(pa.large_binary()))
        if not whole.any():
            return made
        own = self.tokenizer.encode_batch_fast([x[1:].decode() for x in parts.filter(pa.array(whole)).to_pylist()], add_special_tokens=False)
        made = pa.concat_arrays([made, pa.array([np.array(e.ids, "<u4").tobytes() for e in own], pa.large_binary())])
        return made.take(pa.array(np.argsort(np.argsort(whole, kind="stable"))))

    def _merged(self, parts: pa.Array) -> pa.Array:
        """Packed ids of each part, from the library's model; none for an empty one."""
        full = pc.greater(pc.binary_length(parts), 0)
        some = parts.filter(full)
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(some), 2000):
            bare = some.slice(at, 2000).to_pylist()
            line = _BYTES[np.frombuffer(b"\xff".join(bare), np.uint8)].tobytes().decode("utf-32-le")
            made = np.array(self.parted.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            # The fast call doesn't tell parts apart: tokens are counted by the bytes they stand for.
            ends, stops = np.cumsum(self.bytes_of[made]), np.cumsum(list(map(len, bare)))
            last = np.searchsorted(ends, stops)
            if not len(ends) or ends[-1] != stops[-1] or (ends[last] != stops).any():
                slow = self.parted.encode_batch([line], add_special_tokens=False)[0]
                made, last = np.array(slow.ids, "<u4"), np.append(np.flatnonzero(np.diff(slow.word_ids)), len(slow.ids) - 1)
            ids.append(made)
            counts.append(np.diff(last, prepend=-1))
        flat, count = np.concatenate(ids), np.concatenate(counts)
        if len(count) != len(some):
            raise ValueError("the model gave no id for a part")
        size = np.zeros(len(parts) + 1, np.int64)
        size[1:][full.to_numpy(zero_copy_only=False)] = 4 * count
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(np.cumsum(size)), pa.py_buffer(flat)])


def _ends(values: pa.LargeBinaryArray) -> np.ndarray:
    """Where values begin in their buffer, and where the last one ends."""
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of about SLICE_BYTES."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)))
        yield texts.slice(at, stop - at)
        at = stop


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, made once."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def forget() -> None:
    """Drops what this worker's encoders remember: workers are reused, and another operator needs the room."""
    for known in _made.values():
        known.forget()
