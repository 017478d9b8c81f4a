"""Token ids of texts by a public tokenizer.

The tokenizer drops white space, and nothing it does reaches across it: the ids of a text
are the ids of its words, one after the other. Of a word of letters with punctuation behind it, letters
and punctuation are parted, as the tokenizer does too. Such units repeat, so those of a few megabytes
of text are numbered by Arrow, the distinct ones are encoded, and ids are gathered by number.
Each worker keeps the ids of the first ``MOST_KEPT`` units it meets; all others are encoded anew.
"""

from __future__ import annotations

import os
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reviewops.llm import scan

END = 2
MOST_KEPT = 400_000
LONGEST_KEPT = 48
#: Bytes of text taken at once: the more, the fewer units are looked up again.
PIECE = 1 << 22


def _bytes(characters: str) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(characters.encode())] = True
    return found


#: A run of these behind letters is a token run of its own; an apostrophe might belong to the letters.
_STOP = _bytes(string.punctuation.replace("'", ""))
_LETTER = _bytes(string.ascii_letters)
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is C3: all but the signs for times and divided by.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _units(data: np.ndarray, words: scan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all units one after the other, where each ends, whether it is letters only, and how many units a word has."""
    starts, stops = words.starts, words.stops
    letter = _LETTER[data]
    latin = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    letter[:-1] |= latin
    letter[1:] |= latin
    at = np.arange(len(data))
    firm = np.maximum.accumulate(np.where(_STOP[data], -1, at))  # the last byte up to here that isn't such punctuation
    middle = np.maximum(firm[stops - 1] + 1, starts)  # where trailing punctuation begins
    odd = np.concatenate(([0], np.cumsum(~letter)))
    plain = (middle > starts) & (odd[middle] == odd[starts])  # letters, then nothing but punctuation
    parted = plain & (middle < stops)
    count = 1 + parted.astype(np.int64)
    last = np.cumsum(count) - 1
    lengths = np.empty(int(count.sum()), dtype=np.int64)
    lengths[last] = stops - starts
    lengths[last[parted]] = (stops - middle)[parted]
    lengths[last[parted] - 1] = (middle - starts)[parted]
    letters = np.zeros(len(lengths), dtype=bool)
    letters[last[plain] - parted[plain]] = True
    kept = ~scan.SPACE[data]
    lowered = np.where(letter, scan.LOWER[data], data) if plain.all() else _lowered(data, starts, middle, plain)
    return lowered[kept], np.cumsum(lengths), letters, count


def _lowered(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The bytes, A-Z lower-cased in the given spans: what isn't letters only is left to the tokenizer as it is."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts[which]] += 1
    edge[stops[which]] -= 1
    return np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, scan.LOWER[data], data)


class _Ids:
    """Ids of a list of units, one after the other: those of unit i are flat[ends[i] - sizes[i]:ends[i]]."""

    def __init__(self, units: pa.Array, flat: np.ndarray, sizes: np.ndarray):
        self.units, self.flat, self.sizes = units, flat, sizes
        self.ends = np.cumsum(sizes)

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in the given order, and how many of each."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.ends[at] - ends, sizes) + np.arange(total)], sizes


class Encoder:
    """Ids as numbers of a numpy kind, such as ``<u4``."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(kind)
        size = self.tokenizer.get_vocab_size()
        #: ids that end a run of letters
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.kept = _Ids(pa.array([], pa.binary()), np.empty(0, dtype=self.kind), np.empty(0, dtype=np.int64))

    def _one_by_one(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], dtype=self.kind), np.array([len(ids) for ids in found], dtype=np.int64)

    def _letters(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Units of letters only: encoded as one text and cut behind the ids that end a word."""
        if not units:
            return np.empty(0, dtype=self.kind), np.empty(0, dtype=np.int64)
        whole, = self.tokenizer.encode_batch_fast([b" ".join(units).decode()], add_special_tokens=False)
        ids = np.array(whole.ids, dtype=np.int64)
        cuts = np.flatnonzero(self.last[ids]) + 1
        if len(cuts) != len(units) or cuts[-1] != len(ids):
            return self._one_by_one([u.decode() for u in units])
        return ids.astype(self.kind), np.diff(cuts, prepend=0)

    def _encoded(self, units: pa.Array, letters: np.ndarray) -> _Ids:
        """Ids of distinct units."""
        known = pc.index_in(units, self.kept.units).to_numpy(zero_copy_only=False)  # NaN where there are none
        new = np.isnan(known)
        fresh = np.concatenate([np.flatnonzero(new & letters), np.flatnonzero(new & ~letters)])
        number = int((new & letters).sum())
        names = units.take(pa.array(fresh))
        listed = names.to_pylist()
        one, two = self._letters(listed[:number]), self._one_by_one([u.decode("utf-8", "replace") for u in listed[number:]])
        found = _Ids(names, np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]))
        both = _Ids(pa.concat_arrays([self.kept.units, names]), np.concatenate([self.kept.flat, found.flat]), np.concatenate([self.kept.sizes, found.sizes]))
        place = np.where(new, 0, known).astype(np.int64)
        place[fresh] = len(self.kept.sizes) + np.arange(len(fresh))
        flat, sizes = both.taken(place)
        room = MOST_KEPT - len(self.kept.sizes)
        if room > 0 and len(fresh):
            short = np.flatnonzero(pc.binary_length(names).to_numpy() <= LONGEST_KEPT)[:room]
            more, more_sizes = found.taken(short)
            self.kept = _Ids(pa.concat_arrays([self.kept.units, names.take(pa.array(short))]), np.concatenate([self.kept.flat, more]),
                             np.concatenate([self.kept.sizes, more_sizes]))
        return _Ids(units, flat, sizes)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text, without an end."""
        flat, begins = self.ids(pa.array(texts, pa.binary()))
        return [flat[a:b].tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, without ends, and where each text begins, with the end of the last behind."""
        data, ends = scan.texts(texts)
        words = scan.Words(data, ends)
        if not len(words.starts):
            return np.empty(0, dtype=self.kind), np.zeros(len(ends), dtype=np.int64)
        joined, unit_ends, letters, count = _units(data, words)
        spans = pa.py_buffer(np.concatenate(([0], unit_ends)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(unit_ends), [None, spans, pa.py_buffer(joined)]).dictionary_encode()
        numbers = coded.indices.to_numpy()
        units = coded.dictionary.cast(pa.binary())
        plain = np.zeros(len(units), dtype=bool)
        plain[numbers[letters]] = True
        flat, sizes = self._encoded(units, plain).taken(numbers)
        before = np.concatenate(([0], np.cumsum(sizes)))
        units_before = np.concatenate(([0], np.cumsum(count)))
        return flat, before[units_before[words.first]]


@lru_cache(maxsize=2)
def encoder(path: str, kind: str = "<u4") -> Encoder:
    """The worker's encoder, kept for its next tasks."""
    return Encoder(path, kind)
