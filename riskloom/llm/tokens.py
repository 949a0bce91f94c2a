"""Token ids of whole texts, with a bounded cache of encoded words.

``word_bpe_49k`` cuts at white space before it merges, and neither its
normaliser nor its word pattern looks across white space.  So the ids of a text
are the ids of its blank-separated pieces in a row, and each distinct piece has
to be encoded only once per worker process.  A piece of letters (A-Z and the
Latin letters of two bytes that begin with C3), digits and other ASCII is cut
further, where the word pattern cuts: into runs of letters, runs of others and
single digits, in lower case.  A piece with anything else, with an apostrophe
(contractions) or with "<" (special tokens) stays whole and as it is.

Pieces of up to 16 bytes are found in an open-addressing table by their bytes,
a whole batch at a time; longer ones in a dict.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .common import ranges, utf8_buffers

SLOTS = 1 << 21
CACHE_ENTRIES = SLOTS * 5 // 8
SHORT = 16
#: Stands between words that are encoded in one call; a word that holds it is encoded alone.
MARK = "\x01"
_STATE: dict = {}
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER, _DIGIT, _OTHER, _WHOLE = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:] = _CLASS[[0x27, 0x3C]] = _WHOLE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


def _only_letters(word: bytes) -> bool:
    return _LETTERS(word.decode()) is not None


class Encoder:
    """Encodes with one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.mark_ids = self.tok.encode(MARK, add_special_tokens=False).ids
        # A run of letters is one word to the merges: it goes to them straight, its
        # bytes as the byte-level step spells them, if that gives the same ids here.
        self.merges = self.tok.model
        spelled = {c: "".join(p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(c)) for c in map(chr, range(0xC0, 0x100))}
        self.spelling = str.maketrans(spelled)
        probes = ["the", "élève", "zzxqj", "straße", "ñandú", "a", "ùàÿ"]
        self.straight = all(self._letters(w) == self.tok.encode(w, add_special_tokens=False).ids for w in probes)
        self._clear()

    def _letters(self, word: str) -> list[int]:
        return [t.id for t in self.merges.tokenize(word.lower().translate(self.spelling))]

    def _clear(self) -> None:
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.size = np.zeros(SLOTS, np.uint8)  # 0: free
        self.entry = np.zeros(SLOTS, np.int32)
        self.long: dict[bytes, int] = {}
        self.offset, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.entries = self.filled = 0

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, many words to a call."""
        if self.straight:
            done = [self._letters(w.decode()) if _only_letters(w) else None for w in words]
            rest = iter(self._others([w for w, d in zip(words, done) if d is None]))
            return [next(rest) if d is None else d for d in done]
        return self._others(words)

    def _others(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        if len(self.mark_ids) != 1:
            return [self.tok.encode(w.decode(), add_special_tokens=False).ids for w in words]
        mark = self.mark_ids[0]
        plain = [w for w in words if MARK.encode() not in w]
        ids = np.array(self.tok.encode(f" {MARK} ".join(w.decode() for w in plain), add_special_tokens=False).ids if plain else [], np.int64)
        cut = np.flatnonzero(ids == mark)
        if plain and len(cut) == len(plain) - 1:
            starts, ends = np.append(0, cut + 1).tolist(), np.append(cut, len(ids)).tolist()
            flat = ids.tolist()
            pieces = iter([flat[a:b] for a, b in zip(starts, ends)])
        else:
            pieces = iter([self.tok.encode(w.decode(), add_special_tokens=False).ids for w in plain])
        for w in words:
            out.append(next(pieces) if MARK.encode() not in w else self.tok.encode(w.decode(), add_special_tokens=False).ids)
        return out

    def _add(self, ids: list[list[int]]) -> int:
        """Store ids as new entries; returns the number of the first."""
        first, n = self.entries, sum(map(len, ids))
        while self.entries + len(ids) > len(self.offset):
            self.offset, self.count = np.append(self.offset, self.offset), np.append(self.count, self.count)
        while self.filled + n > len(self.pool):
            self.pool = np.append(self.pool, self.pool)
        size = np.array([len(i) for i in ids], np.int64)
        self.count[first:first + len(ids)] = size
        self.offset[first:first + len(ids)] = self.filled + np.cumsum(size) - size
        self.pool[self.filled:self.filled + n] = np.fromiter((t for i in ids for t in i), np.uint32, n)
        self.entries += len(ids)
        self.filled += n
        return first

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) + size
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xA0761D6478BD642F)
        return (h >> np.uint64(64 - 21)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entry of each short word, -1 where it is not known."""
        out = np.full(len(low), -1, np.int64)
        todo, slot = np.arange(len(low)), self._slot(low, high, size)
        while len(todo):
            used = self.size[slot]
            same = (self.low[slot] == low[todo]) & (self.high[slot] == high[todo]) & (used == size[todo])
            out[todo[same]] = self.entry[slot[same]]
            more = ~same & (used > 0)
            todo, slot = todo[more], (slot[more] + 1) % SLOTS
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, first: int) -> None:
        """Put distinct short words into free slots as entries first, first + 1, ..."""
        todo, slot = np.arange(len(low)), self._slot(low, high, size)
        while len(todo):
            free = np.flatnonzero(self.size[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)  # one winner for each slot
            win = free[one]
            s, k = slot[win], todo[win]
            self.low[s], self.high[s], self.size[s], self.entry[s] = low[k], high[k], size[k], first + k
            left = np.ones(len(todo), bool)
            left[win] = False
            todo, slot = todo[left], (slot[left] + 1) % SLOTS

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts in a row, ``end_id`` last in
        each, and n+1 offsets.  A null counts as empty."""
        data, off = utf8_buffers(texts)
        n = len(off) - 1
        inside = ~_BLANK[data]
        # A piece begins at its first byte after a blank or after the text's begin.
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        at = off[:-1][off[:-1] < len(data)]
        begin[at] = inside[at]
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        tail = data[lead + 1]
        lead = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        chunk = np.flatnonzero(begin)
        whole = np.unique(np.searchsorted(chunk, np.flatnonzero(inside & (kind == _WHOLE)), side="right") - 1)
        data = np.append(data, np.uint8(32))
        if len(whole):
            edge = np.zeros(len(data), np.int8)
            edge[chunk[whole]] = 1
            after = np.append(chunk, len(data) - 1)[whole + 1]
            edge[after] -= 1
            as_is = np.cumsum(edge, dtype=np.int8)[:-1] > 0
            kind[as_is] = _WHOLE
            data[:-1] = np.where(as_is, data[:-1], _LOWER[data[:-1]])
        else:
            data = _LOWER[data]
        begin[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        start = np.flatnonzero(begin)
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | begin[1:]
        size = np.flatnonzero(stop) + 1 - start
        # The end id of a text is a word after its last.
        words = np.searchsorted(start, off[1:])
        ids, counts, done = [], [], 0
        # So many words at a time that all of them fit into the table as new ones;
        # their ids are copied out before it may be cleared for the next.
        step = max(1, CACHE_ENTRIES // 2)
        for lo in range(0, max(1, len(start)), step):
            hi = min(lo + step, len(start))
            a, b = (start[lo], start[hi - 1] + size[hi - 1]) if hi else (0, 0)
            entry = self._entries(data[a:b], start[lo:hi] - a, size[lo:hi], end_id)
            ends = n if hi == len(start) else int(np.searchsorted(words, hi))
            entry = np.insert(entry, words[done:ends] - lo, self.end)
            done = ends
            count = self.count[entry].astype(np.int64)
            ids.append(self.pool[ranges(self.offset[entry], count)])
            counts.append(count)
        total = np.append(0, np.cumsum(np.concatenate(counts)))
        return ids[0] if len(ids) == 1 else np.concatenate(ids), np.append(0, total[words + np.arange(1, n + 1)])

    def _entries(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, end_id: int) -> np.ndarray:
        """Entry of each word, for at most half of CACHE_ENTRIES words: the table
        holds CACHE_ENTRIES at most, so it always has free slots."""
        if self.entries + len(start) > CACHE_ENTRIES and self.entries > CACHE_ENTRIES // 2:
            self._clear()
        if not self.entries:
            self.end_id, self.end = end_id, self._add([[end_id]])
        elif self.end_id != end_id:
            self.end_id, self.end = end_id, self._add([[end_id]])
        short = np.flatnonzero(size <= SHORT)
        padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
        wide = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        s, k = start[short], size[short]
        low = wide[s] & _MASK[np.minimum(k, 8)]
        high = wide[np.minimum(s + 8, len(wide) - 1)] & _MASK[np.maximum(k - 8, 0)]
        length = k.astype(np.uint8)
        entry = np.empty(len(start), np.int64)
        found = self._find(low, high, length)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = np.lexsort((length[new], high[new], low[new]))
            o = new[order]
            differ = np.ones(len(o), bool)
            differ[1:] = (low[o[1:]] != low[o[:-1]]) | (high[o[1:]] != high[o[:-1]]) | (length[o[1:]] != length[o[:-1]])
            reps = o[differ]
            raw = data.tobytes()
            first = self._add(self._ids([raw[a:a + b] for a, b in zip(s[reps].tolist(), k[reps].tolist())]))
            self._insert(low[reps], high[reps], length[reps], first)
            found[o] = first + np.cumsum(differ) - 1
        entry[short] = found
        far = np.flatnonzero(size > SHORT)
        if len(far):
            words = [data[a:a + b].tobytes() for a, b in zip(start[far].tolist(), size[far].tolist())]
            new_words = list(dict.fromkeys(w for w in words if w not in self.long))
            if new_words:
                first = self._add(self._ids(new_words))
                self.long.update(zip(new_words, range(first, first + len(new_words))))
            entry[far] = [self.long[w] for w in words]
        return entry


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and worker process."""
    if path not in _STATE:
        _STATE[path] = Encoder(path)
    return _STATE[path]
