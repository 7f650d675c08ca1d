"""Token ids of whole texts, from a tokenizer file of the tokenizers library.

``by_words`` is for tokenizers that lower-case, drop white space and then split into
runs of letters, single digits and runs of other signs, closing each with an end-of-word
mark: there a text's ids are the ids of its pieces in order, so each piece is encoded
once by the library and its packed ids are kept. Words of ASCII and common Latin letters
are split here; other words are left to the library whole. Words and pieces are split,
numbered and put together as arrays; only distinct ones are looked up one by one. Caches are bounded in entries
and in their length; they change the time that encoding takes, never the ids. Without
``by_words`` the library encodes whole texts.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Entries of a cache's young generation, and the length from which words aren't kept.
CACHED, CACHED_LENGTH = 250_000, 48
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
IN_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: Kinds of bytes in lower-cased words of ASCII, À-Ö, Ø-ö and ø-ÿ: white space, digits, letters, other signs.
SPACE, DIGIT, LETTER, SIGN = range(4)
KINDS = np.array([SPACE if b == 0x20 else DIGIT if 0x30 <= b <= 0x39 else LETTER if 0x61 <= b <= 0x7A or b >= 0x80 else SIGN for b in range(256)], np.uint8)
#: A quote that begins a run of signs takes these letters along.
ONE, TWO = tuple(b"stmd"), tuple(int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll"))
TOGETHER = 500


def arrow_words(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words of these lengths that lie one behind the other in ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def numbered(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of ``arrow_words``, and each word's number among them."""
    if not len(words):
        return [], np.zeros(0, np.int64)
    got = words.dictionary_encode()
    _, offsets, data = got.dictionary.buffers()
    raw = data.to_pybytes()  # slices of it are made far faster than Arrow makes its lists
    return [raw[a:b] for a, b in pairwise(np.frombuffer(offsets, np.int64)[: len(got.dictionary) + 1].tolist())], got.indices.to_numpy()


def split_words(texts: list[bytes], table: bytes | None = None) -> tuple[pa.Array, np.ndarray]:
    """All texts' words ``[^\\x20\\x09-\\x0D]+``, translated by ``table``, and how many each text has."""
    data = b" ".join([*texts, b""])
    data = np.frombuffer(data.translate(table) if table else data, np.uint8)
    inside = IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # words begin and end, by turns
    edges += 1
    if len(data) and inside[0]:
        edges = np.concatenate([[0], edges])
    begins = edges[::2]
    n_words = np.diff(np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    return arrow_words(data[inside], edges[1::2] - begins), n_words


def split_pieces(words: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased pieces of words in the letters of ``KINDS``, and how many each word has.

    These are the matches of 's|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+
    """
    data = np.frombuffer(b" ".join([*words, b"", b""]).translate(LOWER), np.uint8)
    if (data >= 0x80).any():
        last, data = data[:-1] == 0xC3, data.copy()
        high = data[1:]
        high[last & (high >= 0x80) & (high <= 0x9E)] += 0x20
    kind = KINDS[data]
    begins = kind == DIGIT
    begins[0] = True
    begins[1:] |= kind[1:] != kind[:-1]
    quotes = np.flatnonzero((data == 0x27) & begins)
    after, second = data[quotes + 1], data[quotes + 2]
    for n, found in ((1, np.isin(after, ONE)), (2, np.isin(after.astype(int) << 8 | second, TWO))):
        begins[quotes[found] + 1] = False
        begins[quotes[found] + 1 + n] = True
    edges = np.flatnonzero(begins)
    lengths = np.diff(edges, append=len(data))
    held = kind[edges] != SPACE
    edges, lengths = edges[held], lengths[held]
    first = np.flatnonzero((edges == 0) | (kind[edges - 1] == SPACE))
    return arrow_words(data[kind != SPACE], lengths), np.diff(first, append=len(edges))


def is_simple(words: list[bytes]) -> np.ndarray:
    """Which words hold no other letters than those of ``KINDS``: their lower case and composition are the same in every Unicode version."""
    data = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    other = data >= 0x80
    out = np.ones(len(words), bool)
    if other.any():
        other &= data != 0xC3
        other[1:] &= (data[:-1] != 0xC3) | (data[1:] == 0x97) | (data[1:] == 0xB7)
        out[np.searchsorted(np.cumsum([len(w) + 1 for w in words]), np.flatnonzero(other), side="right")] = False
    return out


def put_together(blobs: list[bytes], at: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Of the ids in ``blobs[k]`` for each k of ``at``, in order: as many such blobs in one as ``counts`` says, one after the other."""
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2
    ids = np.frombuffer(b"".join(blobs), "<u4")
    ends = np.zeros(len(at) + 1, np.int64)
    own = sizes[at]
    np.cumsum(own, out=ends[1:])
    from_ = (np.cumsum(sizes) - sizes)[at] - ends[:-1]
    raw = ids[np.repeat(from_, own) + np.arange(ends[-1])].tobytes()
    return [raw[a:b] for a, b in pairwise((4 * ends[np.concatenate([[0], np.cumsum(counts)])]).tolist())]


class Cache:
    """Two generations: what is used again moves to the young one, so common words stay."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def found(self, keys: list[bytes]) -> tuple[list, list[int]]:
        """The values of distinct keys, and the places of those that are in neither generation; the others are made young."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old.get
        out = list(map(young.get, keys))
        missing = [k for k, v in enumerate(out) if v is None]
        if self.old:
            for k in missing:
                v = old(keys[k])
                if v is not None:
                    young[keys[k]] = out[k] = v
            missing = [k for k in missing if out[k] is None]
        return out, missing


class Encoder:
    """Texts in UTF-8 to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, definition: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.by_words = by_words
        self.words, self.pieces = Cache(CACHED), Cache(CACHED)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _library(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Encode new pieces, many in one text: each ends where an end-of-word mark is."""
        out: list[bytes] = []
        for a in range(0, len(pieces), TOGETHER):
            own = pieces[a : a + TOGETHER]
            [raw] = self._library([b" ".join(own).decode("utf-8")])
            cuts = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1
            if len(cuts) != len(own):  # a piece that the library would split further
                out += self._library([p.decode("utf-8") for p in own])
                continue
            out += [raw[a:b] for a, b in pairwise([0, *(4 * cuts).tolist()])]
        return out

    def _words(self, new: list[bytes], special: list[bytes]) -> list[bytes]:
        simple = is_simple(new)
        if special:
            simple &= [not any(s in w for s in special) for w in new]
        out: list = [None] * len(new)
        at = np.flatnonzero(simple).tolist()
        if at:
            pieces, counts = split_pieces([new[k] for k in at])
            distinct, numbers = numbered(pieces)
            ids, missing = self.pieces.found(distinct)
            fresh = [distinct[k] for k in missing]
            for k, piece, own in zip(missing, fresh, self._pieces(fresh), strict=True):
                ids[k] = self.pieces.young[piece] = own
            for k, own in zip(at, put_together(ids, numbers, counts), strict=True):
                out[k] = own
        at = np.flatnonzero(~simple).tolist()
        for k, own in zip(at, self._library([new[k].decode("utf-8") for k in at]), strict=True):
            out[k] = own
        return out

    def packed(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return self._library([t.decode("utf-8") for t in texts])
        words, counts = split_words(texts)
        distinct, numbers = numbered(words)
        ids, missing = self.words.found(distinct)
        fresh = [distinct[k] for k in missing]
        for k, word, own in zip(missing, fresh, self._words(fresh, [s for s in self.special if any(s in t for t in texts)]), strict=True):
            ids[k] = own
            if len(word) <= CACHED_LENGTH:
                self.words.young[word] = own
        return put_together(ids, numbers, counts)


@lru_cache(maxsize=2)
def encoder(definition: str, by_words: bool) -> Encoder:
    """The process's encoder: what one task has cached serves the next."""
    return Encoder(definition, by_words)


def vocabulary_size(definition: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition).get_vocab_size()


def groups_of(texts: list[bytes], most: int = 1 << 21):
    """(from, to) of runs of texts with at most ``most`` bytes each, one text at least."""
    a, size = 0, 0
    for b, text in enumerate(texts):
        if size + len(text) > most and b > a:
            yield a, b
            a, size = b, 0
        size += len(text)
    if a < len(texts):
        yield a, len(texts)
