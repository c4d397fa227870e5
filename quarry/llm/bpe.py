"""Token ids of a word-level BPE vocabulary, fast over whole corpora.

The vocabulary's own file gives normaliser, splitter and merges; ``encode`` of the tokenizers library is the rule. For texts of characters
below U+0250 (all in normal form already) the words are found with an equivalent pattern and encoded once per worker: unseen words are
merged together in numpy, lowest rank first and leftmost on ties, as the library does; any other text goes to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Texts of these characters only: composed, with no white space or digits but those that the patterns here name.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+")
_MAX_WORD = 48


class WordBpe:
    """Encoder with a cache of at most ``most`` words."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.rule = Tokenizer.from_file(path)
        self.rule.encode_special_tokens = True  # marks that stand in a text are text
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter, extra = {b: chr(b) for b in printable}, 0
        for b in range(256):
            if b not in letter:
                letter[b] = chr(256 + extra)
                extra += 1
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letter[b] + "</w>"] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.rank = np.arange(len(pairs))[order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._table(key[order])
        self.most = most
        self.cache: dict[str, bytes] = {}

    def _table(self, keys: np.ndarray) -> None:
        """An open hash table of merge pairs."""
        self.bits = 18
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        self.value = np.zeros(len(self.slots), np.int64)
        home = self._home(keys)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = home[left] + step
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]  # of several, the last one stays
            won = self.slots[at] == keys[left]
            self.value[at[won]] = self.rank[left[won]]
            left, step = left[~won], step + 1
        self.steps = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        at = self._home(keys)
        out = np.full(len(keys), 1 << 30, np.int64)
        got = self.slots[at]
        hit = got == keys
        out[hit] = self.value[at[hit]]
        left = np.flatnonzero(~hit & (got >= 0))
        for _ in range(1, self.steps):
            if not len(left):
                break
            at[left] += 1
            got = self.slots[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.value[at[left[hit]]]
            left = left[~hit & (got >= 0)]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        for length in np.unique(size):
            mine = np.flatnonzero(size == length)
            for k in range(0, len(mine), 1 << 15):
                part = mine[k : k + (1 << 15)]
                ids, count = self._merge_equal(np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), length))
                flat = ids.astype("<u4")
                for i, row, n in zip(part.tolist(), flat, count.tolist(), strict=True):
                    out[i] = row[:n].tobytes()
        return out

    def _merge_equal(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = raw.shape
        s = self.inner[raw]
        s[:, -1] = self.final[raw[:, -1]]
        count = np.full(n, length)
        if length == 1:
            return s, count
        none = 1 << 30
        r = self._ranks(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(n, length - 1)
        live = np.arange(n)
        cols = np.arange(length)
        while len(live):
            best = r[live].argmin(1)
            low = r[live, best]
            go = low < none
            live, best, low = live[go], best[go], low[go]
            if not len(live):
                break
            s[live, best] = self.made[low]
            # What stands right of the merged pair moves left by one.
            sub = s[live]
            shift = cols[None, :-1] > best[:, None]
            sub[:, :-1] = np.where(shift, sub[:, 1:], sub[:, :-1])
            s[live] = sub
            rs = r[live]
            if rs.shape[1] > 1:
                rs[:, :-1] = np.where(cols[None, : length - 2] >= best[:, None], rs[:, 1:], rs[:, :-1])
            rs[:, -1] = none
            count[live] -= 1
            k = np.flatnonzero(best > 0)
            rs[k, best[k] - 1] = self._ranks(sub[k, best[k] - 1], sub[k, best[k]])
            k = np.flatnonzero(best < count[live] - 1)
            rs[k, best[k]] = self._ranks(sub[k, best[k]], sub[k, best[k] + 1])
            r[live] = rs
        return s, count

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; a null text has none."""
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
        out: list[bytes] = []
        split: list[list[str] | None] = []
        unseen: set[str] = set()
        for t in texts:
            if not t or not PLAIN.fullmatch(t):
                split.append(None)
                continue
            words = _SPLIT.findall(t.lower())
            split.append(words)
            unseen.update(words)
        unseen = {w for w in unseen if w not in cache}
        if unseen:
            fresh = [w for w in unseen if len(w) <= _MAX_WORD]
            cache.update(zip(fresh, self.merge([w.encode() for w in fresh]), strict=True))
            for w in unseen:
                if len(w) > _MAX_WORD:
                    cache[w] = self._by_rule(w)
        for t, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self._by_rule(t) if t else b"")
            else:
                out.append(b"".join(map(cache.__getitem__, words)))
        return out

    def _by_rule(self, text: str) -> bytes:
        return np.array(self.rule.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
