"""Whole texts to token ids with the tokenizers library, each distinct word encoded once per worker.

The byte-level vocabulary splits a text into pieces before it merges bytes. It always starts a new
piece at a space or a line break that stands between two non-spaces, and after a word of letters. So
the ids of a text with only such white space are those of its words (with the space or break before
each), one after the other: Arrow numbers the words of a batch, the library encodes each new word
once, and numpy gathers the ids. Other texts, and all texts of a vocabulary that splits otherwise, are
encoded whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a worker remembers unless told otherwise (about 180 bytes each), and words of one call.
CACHE_WORDS = 800_000
CALL_WORDS = 4_000
#: White space other than single spaces and single breaks between non-spaces.
_WHOLE = (
    r"  | \n|\n |\n\n|^[ \n]|[ \n]$|[\t\r\f\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}\x{180e}\x{200b}\x{feff}]"
)


def default_vocabulary() -> str:
    """The path of the public byte-level vocabulary; a parameter of every operator that encodes."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to unsigned 32-bit ids, without special tokens."""

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._tokenizer.encode_special_tokens = True
        self.size = self._tokenizer.get_vocab_size()
        self._most = cache_words
        # Only this split is known to begin a piece at single spaces and breaks.
        split = "".join(repr(self._tokenizer.pre_tokenizer).split())
        self._by_words = split.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in split and self._tokenizer.normalizer is None
        if self._by_words:
            (self._break,) = self._ids(["\n"])[0]
            self._marks = {m: np.asarray(self._ids([m])[0], "<u4") for m in (".", ",")}
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._sizes = np.empty(0, np.int32)
        self._first = np.empty(0, np.int64)
        self._table = np.empty(0, "<u4")
        self._words_held = self._ids_held = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of words that begin with a space or a break; a call encodes many, a break before each."""
        ids, sizes = [], []
        for i in range(0, len(words), CALL_WORDS):
            part = words[i : i + CALL_WORDS]
            got = np.asarray(self._ids(["".join(w if w[0] == "\n" else "\n" + w for w in part)])[0], "<u4")
            at = np.flatnonzero(got == self._break)
            own = np.fromiter((w[0] == "\n" for w in part), bool, len(part))
            keep = np.ones(len(got), bool)
            keep[at[~own]] = False
            ids.append(got[keep])
            sizes.append(np.diff(at, append=len(got)) - ~own)
        return np.concatenate(ids), np.concatenate(sizes)

    def _remember(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self._words_held, self._ids_held
        self._place.update(zip(words, range(n, n + len(words))))
        self._first, self._sizes = _with_room(self._first, n + len(words)), _with_room(self._sizes, n + len(words))
        self._table = _with_room(self._table, m + len(ids))
        self._first[n : n + len(words)] = m + np.cumsum(sizes) - sizes
        self._sizes[n : n + len(words)] = sizes
        self._table[m : m + len(ids)] = ids
        self._words_held, self._ids_held = n + len(words), m + len(ids)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Places of distinct words (without their space); a word of letters and one mark is two pieces."""
        known = self._place
        if len(known) > self._most:
            self._forget()
            known = self._place
        place = list(map(known.get, words))
        fresh = [w for w, at in zip(words, place) if at is None]
        if not fresh:
            return np.asarray(place)
        base = [w[:-1] if w[-1:] in (".", ",") and w[:-1].isalpha() else w for w in fresh]
        new = [w for w in dict.fromkeys(base) if w not in known]
        if new:
            self._remember(new, *self._words([w if w[:1] == "\n" else " " + w for w in new]))
        known = self._place
        marked = [(w, known[b]) for w, b in zip(fresh, base) if w is not b and w not in known]
        for mark, ids in self._marks.items():
            own = [(w, at) for w, at in marked if w[-1] == mark]
            if own:
                at = np.asarray([x for _, x in own])
                flat = _gather(self._table, self._first[at], self._sizes[at])
                ends = np.cumsum(self._sizes[at])
                flat = np.insert(flat, np.repeat(ends, len(ids)), np.tile(ids, len(own)))
                self._remember([w for w, _ in own], flat, self._sizes[at] + len(ids))
        return np.asarray([known[w] if at is None else at for w, at in zip(words, place)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one more than texts)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self._by_words:
            all_ids = [np.asarray(x, "<u4") for x in self._ids(texts.to_pylist())]
            return np.concatenate([np.empty(0, "<u4"), *all_ids]), np.concatenate(([0], np.cumsum([len(x) for x in all_ids], dtype=np.int64)))
        whole = np.asarray(pc.or_(pc.match_substring_regex(texts, _WHOLE), pc.equal(texts, "")).to_numpy(zero_copy_only=False))
        simple = texts.filter(pa.array(~whole)) if whole.any() else texts
        lengths = np.zeros(len(texts), np.int64)
        flat, counts = self._simple(simple) if len(simple) else (np.empty(0, "<u4"), np.empty(0, np.int64))
        if not whole.any():
            return flat, np.concatenate(([0], np.cumsum(counts)))
        rest = [np.asarray(x, "<u4") for x in self._ids(texts.filter(pa.array(whole)).to_pylist())]
        lengths[~whole], lengths[whole] = counts, [len(x) for x in rest]
        starts = np.concatenate(([0], np.cumsum(lengths)))
        out = np.empty(starts[-1], "<u4")
        out[np.repeat(~whole, lengths)] = flat
        out[np.repeat(whole, lengths)] = np.concatenate(rest)
        return out, starts

    def _simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # A break before the first word too: its id is taken off again.
        spaced = pc.replace_substring(texts, "\n", " \n")
        begin, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        lists = pc.split_pattern(pc.binary_join_element_wise(begin, spaced, nothing), " ")
        words = lists.flatten().dictionary_encode()
        place = self._learn(words.dictionary.to_pylist())[words.indices.to_numpy()]
        sizes = self._sizes[place]
        flat = _gather(self._table, self._first[place], sizes)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bounds = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[offsets]
        return np.delete(flat, bounds[:-1]), np.diff(bounds) - 1


def _gather(table: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of the table, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(first - ends + sizes, sizes) + np.arange(total)]


def _with_room(held: np.ndarray, needed: int) -> np.ndarray:
    """The array, moved to a larger one by half where it is too short, so that growing copies rarely."""
    if needed <= len(held):
        return held
    grown = np.empty(max(needed, len(held) * 3 // 2), held.dtype)
    grown[: len(held)] = held
    return grown


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """The worker process's encoder; another vocabulary or cache size takes its place."""
    if (vocabulary, cache_words) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary, cache_words] = Encoder(vocabulary, cache_words)
    return _ENCODERS[vocabulary, cache_words]
