"""Token ids of whole texts with a public tokenizer file, at the speed of its repeated words.

Byte-level pre-tokenisation never joins what stands before a space that is followed by a non-space with what stands
after, nor letters, digits, marks and a single line feed with each other, so a text can be cut there, and each piece be
encoded once per worker by the tokenizers library.
"""

from __future__ import annotations

import codecs
import os
from dataclasses import dataclass
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa

from .words import Texts, Words, texts_of

#: Pieces after which a worker begins a new cache, about 50 bytes each; of the one before it keeps what comes again.
KEPT_PIECES = 150_000
#: Longer pieces are not kept.
KEPT_LENGTH = 64
#: Words given to the tokenizer's model at once.
WORDS_AT_ONCE = 1 << 14

#: A space before one of these bytes may be followed by white space; texts are not cut there.
_MAYBE_BLANK = np.zeros(256, bool)
_MAYBE_BLANK[:0x21] = True
_MAYBE_BLANK[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Kinds of bytes that no pre-token joins: letters, digits, marks, line feeds; 0: any other. The apostrophe may take
#: letters along, so it is no mark.
_LETTER, _DIGIT, _MARK, _LINE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
for _byte in range(0x21, 0x7F):
    _KIND[_byte] = _LETTER if chr(_byte).isalpha() else _DIGIT if chr(_byte).isdigit() else _MARK if chr(_byte) != "'" else 0
_KIND[0x0A] = _LINE
#: Second bytes of U+00C0 to U+00FF that make a letter: all but the two signs among them.
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False

#: The character that stands for each byte in the vocabulary: itself if it is shown as such, else one from U+0100 on.
_SHOWN, _HIDDEN = "", 0
for _byte in range(256):
    if 0x21 <= _byte <= 0x7E or 0xA1 <= _byte <= 0xAC or 0xAE <= _byte:
        _SHOWN += chr(_byte)
    else:
        _SHOWN += chr(0x100 + _HIDDEN)
        _HIDDEN += 1


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; letters are A-Z and U+00C0 to U+017F but for two signs, whose bytes come in pairs."""
    kinds = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    lead = lead[(data[lead] != 0xC3) | _AFTER_C3[data[lead + 1]]]
    kinds[lead] = kinds[lead + 1] = _LETTER
    return kinds


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) for every pair, end to end."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


@dataclass
class Known:
    """Pieces, ascending by hash: piece i has ``size[i]`` bytes of ``data`` and ``count[i]`` of the ids."""

    hashes: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    data: np.ndarray
    at: np.ndarray
    count: np.ndarray
    ids: np.ndarray

    @classmethod
    def nothing(cls) -> Known:
        none = np.zeros(0, np.int64)
        return cls(np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint8), none, none, np.zeros(0, "<u4"))

    def find(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some pieces are known, byte by byte, and their places here."""
        if not len(self) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[place] == hashes) & (self.size[place] == size))
        place, size = place[hit], size[hit]
        differs = data[_places(begin[hit], size)] != self.data[_places(self.begin[place], size)]
        if differs.any():  # another piece of the same hash
            same = np.ones(len(hit), bool)
            same[np.repeat(np.arange(len(hit)), size)[differs]] = False
            hit, place = hit[same], place[same]
        return hit, place

    def __len__(self) -> int:
        return len(self.hashes)

    def with_more(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, data: np.ndarray, at: np.ndarray, count: np.ndarray, ids: np.ndarray) -> Known:
        """These and other pieces, whose hashes are not here."""
        order = np.argsort(np.concatenate((self.hashes, hashes)), kind="stable")

        def both(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
            return np.concatenate((mine, other))[order]

        return Known(
            both(self.hashes, hashes), both(self.begin, len(self.data) + np.cumsum(size) - size), both(self.size, size),
            np.concatenate((self.data, data[_places(begin, size)])), both(self.at, len(self.ids) + np.cumsum(count) - count), both(self.count, count),
            np.concatenate((self.ids, ids[_places(at, count)])),
        )


class Encoder:
    """Encodes texts to token ids; holds a bounded cache of pieces, those of two turns of KEPT_PIECES."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # Then a word is one pre-token, and its ids are what the model makes of its bytes.
        self.words_alone = isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and self.tokenizer.normalizer is None
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.known, self.before = Known.nothing(), Known.nothing()

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids end to end."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return counts, np.fromiter(chain.from_iterable(found), "<u4", int(counts.sum()))

    def _ids_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of single words, from the tokenizer's model: neither split nor aligned with their text."""
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for at in range(0, len(words), WORDS_AT_ONCE):
            shown, _ = codecs.charmap_decode(b"\n".join(words[at:at + WORDS_AT_ONCE]), "strict", _SHOWN)
            found = list(map(self.model.tokenize, shown.split(_SHOWN[0x0A])))
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), "<u4", int(counts[-1].sum())))
        return np.concatenate(counts), np.concatenate(ids)

    def _begins(self, texts: Texts, kinds: np.ndarray, plain: bool) -> np.ndarray:
        """Where the pieces of all texts begin: no pre-token reaches over such a place, or depends on what is beyond it.

        ``plain`` texts, of a byte-level tokenizer and without added tokens, are also cut where the kind of byte changes.
        """
        data = texts.data
        begins = np.zeros(len(data) + 1, bool)
        begins[:-2] = (data[:-1] == 0x20) & ~_MAYBE_BLANK[data[1:]]
        filled = texts.offsets[1:] > texts.offsets[:-1]
        begins[texts.offsets[1:][filled] - 1] = False  # a space that ends its text
        if plain:
            turn = np.flatnonzero((kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)) + 1
            # What ends in several blanks is split otherwise than if more followed; one line feed alone is not.
            after_line = kinds[turn - 1] == _LINE
            begins[turn[~after_line]] = True
            turn = turn[after_line]
            begins[turn[begins[turn - 1]]] = True
        begins[texts.offsets[:-1][filled]] = True
        return np.flatnonzero(begins)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (unsigned 32-bit), and where each text's begin, with the end; null is empty.

        Equal pieces are encoded once: they are grouped by a hash, and the bytes of all are compared with their group's.
        """
        texts = texts_of(column)
        data = texts.data
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        raw, kinds = data.tobytes(), _kinds(data)
        plain = self.words_alone and not any(x in raw for x in self.added)
        start = self._begins(texts, kinds, plain)
        size = np.diff(start, append=len(data))
        first = np.searchsorted(start, texts.offsets)
        hashes, at, group = np.unique(Words(texts, start, start + size, first).hashes(), return_index=True, return_inverse=True)
        alone = not np.array_equal(size[at][group], size) or not np.array_equal(data[_places(start[at][group], size)], data)
        if alone:  # two pieces of one hash: each by itself, none from the cache
            hashes, group, at = hashes[group], np.arange(len(start)), np.arange(len(start))
        start, size = start[at], size[at]
        begins, counts, ids = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), []
        left, n = np.arange(len(at)), 0
        fresh = []  # pieces that are not in the present cache
        for cache in () if alone else (self.known, self.before):
            hit, place = cache.find(hashes[left], start[left], size[left], data)
            counts[left[hit]] = cache.count[place]
            begins[left[hit]] = n + cache.at[place]
            ids.append(cache.ids)
            n += len(cache.ids)
            if cache is self.before:
                fresh.append(left[hit])
            left = np.delete(left, hit)
        letters = np.concatenate(([0], np.cumsum(kinds == _LETTER)))
        inner = start[left] + ((data[start[left]] == 0x20) & (size[left] > 1))
        end = start[left] + size[left]
        is_word = (letters[end] - letters[inner] == end - inner) & plain
        for some, encode in ((left[is_word], self._ids_of_words), (left[~is_word], self._ids)):
            own, found = encode([raw[a:b] for a, b in zip(start[some].tolist(), (start[some] + size[some]).tolist(), strict=True)])
            counts[some] = own
            begins[some] = n + np.cumsum(own) - own
            ids.append(found)
            n += len(found)
            fresh.append(some)
        table = np.concatenate(ids)
        flat = table[_places(begins[group], counts[group])]
        offsets = np.concatenate(([0], np.cumsum(counts[group])))[first]
        if not alone:
            self._keep(hashes, start, size, data, begins, counts, table, np.sort(np.concatenate(fresh)))
        return flat, offsets

    def _keep(self, hashes, start, size, data, begins, counts, table, fresh) -> None:
        """Adds pieces to the cache, but for long ones and those of which another has the hash."""
        fresh = fresh[size[fresh] <= KEPT_LENGTH]
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known.hashes, hashes[fresh]), len(self.known) - 1)
            fresh = fresh[self.known.hashes[place] != hashes[fresh]]
        self.known = self.known.with_more(hashes[fresh], start[fresh], size[fresh], data, begins[fresh], counts[fresh], table)
        if len(self.known) > KEPT_PIECES:
            self.known, self.before = Known.nothing(), self.known

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        flat, offsets = self.encode_column(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        data, offsets = flat.tobytes(), (4 * offsets).tolist()
        return [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Lets go of this worker's encoders."""
    _ENCODERS.clear()
