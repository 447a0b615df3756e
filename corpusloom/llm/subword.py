"""Subword ids of many words at once: byte-pair merges of a public tokenizer file, done in numpy over all distinct words.

Words of printable ASCII and Latin-1 letters are split and merged here; any other word goes to the tokenizers library, so
ids always equal the library's (strings of special tokens are ordinary text). White space never joins two words in
these vocabularies (word_bpe_49k.json: white space is dropped, words carry an end mark), so texts are split at ASCII white
space and each distinct word is encoded once a block.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_NONE = np.int32(2**31 - 1)
LONGEST = 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Subwords:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self._index(keys)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + model["end_of_word_suffix"]] for s in symbols], np.int32)
        ok = np.zeros(256, bool)
        ok[0x21:0x7F] = ok[0x80:0xC0] = ok[0xC3] = True
        ok[0x27] = False
        self.ok = ok
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        self.lower = low
        kind = np.full(256, 3, np.uint8)
        kind[97:123] = kind[0x80:0xC0] = kind[0xC3] = 1
        kind[48:58] = 2
        self.kind = kind

    def _index(self, keys: np.ndarray) -> None:
        """A table by hash, an eighth full at most: a key lies in the first free slot from its own on."""
        self.bits = max(int(len(keys)).bit_length() + 3, 4)
        self.keys, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        rest = np.arange(len(keys), dtype=np.int32)
        at = self._slot(keys)
        while len(rest):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.rank[at[won]] = keys[rest[won]], rest[won]
            rest, at = np.delete(rest, won), np.delete(at, won) + 1 & len(self.keys) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 16 | b
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.rank[at], _NONE)
        left = np.nonzero((got != key) & (got >= 0))
        while len(left[0]):
            at[left] = at[left] + 1 & len(self.keys) - 1
            got = self.keys[at[left]]
            hit = got == key[left]
            out[tuple(i[hit] for i in left)] = self.rank[at[tuple(i[hit] for i in left)]]
            more = ~hit & (got >= 0)
            left = tuple(i[more] for i in left)
        return out

    def merge(self, sym: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges each row, a word of so many symbols; (rows, their ids) by the number of ids."""
        out, rows = [], np.arange(len(sym))
        rank = self.ranks(sym[:, :-1], sym[:, 1:])
        while len(rows):
            if sym.shape[1] == 1:
                out.append((rows, sym))
                break
            j = rank.argmin(1)
            best = rank[np.arange(len(rows)), j]
            live = best != _NONE
            if not live.all():
                out.append((rows[~live], sym[~live]))
                rows, sym, rank, j, best = rows[live], sym[live], rank[live], j[live], best[live]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            width = sym.shape[1] - 1
            sym[every, j] = self.merged[best]
            at = np.arange(width)[None, :]
            sym = np.take_along_axis(sym, at + (at > j[:, None]), 1)
            rank = np.take_along_axis(rank, at[:, : width - 1] + (at[:, : width - 1] > j[:, None]), 1)
            for k in (j - 1, j):
                has = (k >= 0) & (k < width - 1)
                r, c = every[has], k[has]
                rank[r, c] = self.ranks(sym[r, c], sym[r, c + 1])
        return out

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each word's start (one more at the end)."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        words = pa.concat_arrays([words.cast(pa.string())])
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        lens = np.diff(offsets)
        of = np.repeat(np.arange(n), lens)
        prev = np.concatenate([[np.uint8(0)], raw[:-1]])
        after = prev == 0xC3
        odd = ~self.ok[raw] | after & ((raw == 0x97) | (raw == 0xB7))
        buf = self.lower[raw]
        buf = np.where(after & (raw >= 0x80) & (raw <= 0x9E), buf + np.uint8(32), buf)
        kind = self.kind[buf]
        first = np.zeros(len(buf), bool)
        first[offsets[:-1][lens > 0]] = True
        first[1:] |= kind[1:] != kind[:-1]
        first |= kind == 2
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(buf))
        slow = np.zeros(n, bool)
        slow[of[odd]] = True
        slow[of[starts[ends - starts > LONGEST]]] = True
        slow |= lens == 0
        fine = ~slow[of[starts]]
        starts, ends = starts[fine], ends[fine]
        owner, width = of[starts], ends - starts
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(width):
            which = np.flatnonzero(width == size)
            at = starts[which][:, None] + np.arange(size)
            sym = self.inner[buf[at]]
            sym[:, -1] = self.last[buf[at[:, -1]]]
            found += [(which[r], ids) for r, ids in self.merge(sym)]
        bad = np.flatnonzero(slow)
        library = [e.ids for e in self.library.encode_batch(words.take(pa.array(bad)).to_pylist(), add_special_tokens=False)] if len(bad) else []
        counts = np.zeros(len(starts), np.int64)
        for which, ids in found:
            counts[which] = ids.shape[1]
        per_word = np.bincount(owner, weights=counts, minlength=n).astype(np.int64)
        per_word[bad] = [len(x) for x in library]
        word_at = np.concatenate([[0], np.cumsum(per_word)])
        before = np.cumsum(counts) - counts
        base = before[np.searchsorted(owner, np.arange(n), "left").clip(max=max(len(owner) - 1, 0))] if len(owner) else np.zeros(n, np.int64)
        seg_at = word_at[owner] + before - base[owner] if len(owner) else before
        flat = np.zeros(word_at[-1], np.int32)
        for which, ids in found:
            flat[seg_at[which][:, None] + np.arange(ids.shape[1])] = ids
        for w, ids in zip(bad, library, strict=True):
            flat[word_at[w] : word_at[w + 1]] = ids
        return flat, word_at

    def texts(self, texts: pa.Array, block: int = 1 << 23):
        """(ids, offsets) of runs of texts, in order; nulls have no ids. A run has about `block` bytes, or one text."""
        for _, _, _, ids, at in self.with_words(texts, block):
            yield ids, at

    def with_words(self, texts: pa.Array, block: int = 1 << 23):
        """As texts(), before that the distinct words, the index of each word in them and where texts start among words.

        An empty string among the distinct words stands for white space at the ends of texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // block
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)] if len(texts) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lists = pc.ascii_split_whitespace(texts.slice(a, b - a))
            words, at = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            coded = words.dictionary_encode()
            flat, word_at = self.encode(coded.dictionary)
            index = coded.indices.to_numpy(zero_copy_only=False)
            lens = np.diff(word_at)[index]
            total = np.concatenate([[0], np.cumsum(lens)])
            ids = flat[np.arange(total[-1]) + np.repeat(word_at[index] - total[:-1], lens)] if len(index) else np.zeros(0, np.int32)
            yield coded.dictionary, index, at, ids, total[at]


@lru_cache(2)
def load(path: str) -> Subwords:
    return Subwords(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)
