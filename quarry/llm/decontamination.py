"""Benchmark decontamination: training suffix arrays searched by every benchmark suffix.

Documents are cut into shards of about ``SHARD_BYTES`` of whole texts. Each shard gets a suffix array of its word
positions, and every benchmark suffix is binary-searched in it: the range of suffixes that begin with the suffix's
window gives the verbatim matches and where they are. Only suffixes that start with a word pair of some benchmark suffix enter the
array; no other suffix can match two words of any item, and a window of a single word keeps all suffixes that start with it.

A match is then followed to its full length in the benchmark's own suffix array: blocks of 1, 2, 4, 8... words have ranks there, a
document's block has the rank of the benchmark block that equals it, and a match grows by halving blocks inside a shrinking
range of suffixes. So a match of n words costs log(n) steps, and an item of any length takes memory in proportion to it (times log).

Nothing is shuffled. A benchmark above ``BLOCK_BYTES`` is worked through in blocks inside each task: every shard is searched by one block
after another and the matches of all blocks are pooled per row. Blocks are broadcast one by one, each of bounded size, and a worker
holds one at a time; ids play no part in any decision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernel

WINDOW = 13
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20
#: Words by which a shard's suffixes are ordered; longer windows are compared on from there.
DEPTH = 16


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges lo:hi, one range after another."""
    size = hi - lo
    return np.arange(int(size.sum())) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)


class Items:
    """The benchmark side: word ids, windows and suffixes of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        h, offs = kernel.words(pa.array([t or "" for _, t in items], pa.large_string()))
        self.window, self.names = window, [str(i) for i, _ in items]
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        self.kind = ">u2" if len(self.vocabulary) < 65_000 else ">u4"
        self.few = np.zeros(1 << 20, np.uint8)
        self.few[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = 1
        count = np.diff(offs)
        item = np.repeat(np.arange(len(count)), count)
        # Items stand one after another, each ended by a 0, and so does the text after the last.
        wide = max(window, DEPTH)
        flat = np.zeros(len(ids) + len(count) + wide, np.int64)
        place = np.arange(len(ids)) + item
        flat[place] = ids + 1
        size = np.minimum(window, count)[item]
        starts = np.arange(len(ids)) + size <= offs[1:][item]  # where the item's window still fits
        place, item, size = place[starts], item[starts], size[starts]
        table = np.lib.stride_tricks.sliding_window_view(flat, wide)[place].astype(self.kind) if len(place) else np.zeros((0, wide), self.kind)
        table[np.arange(wide)[None, :] >= size[:, None]] = 0
        row = np.ascontiguousarray(table).view(f"V{table.dtype.itemsize * wide}").ravel() if len(table) else np.zeros(0, "V2")
        _, first, which = np.unique(row, return_index=True, return_inverse=True) if len(row) else (row, np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.words, self.size = table[first].astype(np.int64), size[first]
        # Windows of the same items share one set of them.
        key = np.unique(which.astype(np.int64) * (len(count) + 1) + item)
        ends = np.searchsorted(key // (len(count) + 1), np.arange(len(first) + 1))
        sets: dict[bytes, int] = {}
        self.set_of = np.array([sets.setdefault((key[a:b] % (len(count) + 1)).tobytes(), len(sets)) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
        self.sets = [np.frombuffer(x, np.int64) for x in sets]
        long = self.size > 1
        self.pairs = np.unique(self.words[long, 0] << 32 | self.words[long, 1])
        self.heads = np.unique(self.words[~long, 0])
        low = self.words[:, :DEPTH]
        self.low = self.rows(low)
        self.high = self.rows(np.where(low == 0, np.iinfo(np.dtype(self.kind)).max, low))
        self._order(flat, int(count.max(initial=0)))

    def _order(self, flat: np.ndarray, longest: int) -> None:
        """Ranks of the blocks of 1, 2, 4, ... words at each place, and the suffix array that they lead to."""
        self.ranks, self.pair_keys = [flat.astype(np.int32)], []
        while 1 << len(self.ranks) <= longest:
            keys, rank = np.unique(self._pairs(), return_inverse=True)
            self.pair_keys.append(keys)
            self.ranks.append(rank.astype(np.int32))
        self.array = np.argsort(self._pairs(), kind="stable")

    def _pairs(self) -> np.ndarray:
        """Each place's rank and that of the block behind it, as one number."""
        k, r = 1 << (len(self.ranks) - 1), self.ranks[-1].astype(np.int64)
        pair = r << 32
        pair[:-k] |= r[k:]
        return pair

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Word ids as byte strings that sort as the sequences do."""
        x = np.ascontiguousarray(x.astype(self.kind))
        return x.view(f"S{x.dtype.itemsize * DEPTH}").ravel()

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        if not len(self.vocabulary):
            return out
        near = np.flatnonzero(self.few[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[near]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == h[near]
        out[near[same]] = at[same] + 1
        return out

    def lengths(self, seq: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Of each place of seq, the words of the longest verbatim match with any item from there on."""
        if not len(pos):
            return np.zeros(0, np.int64)
        # Only stretches of the benchmark's words that hold a place take part: they are copied out, each ended by a 0.
        stops = np.append(np.flatnonzero(seq == 0), len(seq))
        stretch, at = np.unique(np.searchsorted(stops, pos), return_inverse=True)
        begin = np.where(stretch > 0, stops[stretch - 1] + 1, 0)
        size = stops[stretch] - begin + 1
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        part = seq[np.minimum(_ranges(begin, begin + size), len(seq) - 1)].copy()
        part[base + size - 1] = 0
        where = base[at] + pos - begin[at]
        names = [np.where(part > 0, part, -1)]  # of each block, the rank of the benchmark block it equals, or -1
        for keys in self.pair_keys:
            k, d = 1 << (len(names) - 1), names[-1]
            then = np.full(len(d), -1, np.int64)
            then[:-k] = d[k:]
            both = np.flatnonzero((d >= 0) & (then >= 0))
            if not len(both):
                break
            pair = d[both] << 32 | then[both]
            found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            rank = np.full(len(d), -1, np.int64)
            hit = keys[found] == pair
            rank[both[hit]] = found[hit]
            names.append(rank)
        size = np.zeros(len(where), np.int64)
        lo, hi = np.zeros(len(where), np.int64), np.full(len(where), len(self.array))
        for k in range(len(names) - 1, -1, -1):
            inside = where + size < len(part)
            want = np.where(inside, names[k][np.minimum(where + size, len(part) - 1)], -1)
            live = np.flatnonzero(want >= 0)
            a = self._bound(k, size[live], lo[live], hi[live], want[live], False)
            b = self._bound(k, size[live], a, hi[live], want[live], True)
            grown = b > a
            mine = live[grown]
            lo[mine], hi[mine] = a[grown], b[grown]
            size[mine] += 1 << k
        return size

    def _bound(self, k: int, skip: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
        """In each range of the suffix array, the first suffix whose block k after ``skip`` words is not below (or is above) want."""
        lo, hi, ranks = lo.copy(), hi.copy(), self.ranks[k]
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) // 2
            value = ranks[np.minimum(self.array[mid] + skip[live], len(ranks) - 1)]
            right = value <= want[live] if after else value < want[live]
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)


def shard_matches(index: Items, h: np.ndarray, offs: np.ndarray) -> dict:
    """The matches in one shard of texts' word hashes: of each match its text, first word, length, window and full length."""
    n = len(offs) - 1
    row = kernel.rows_of(offs)
    seq = np.zeros(len(h) + n + max(DEPTH, index.window) + 1, np.int64)  # a 0 ends each text, and stands for words that no item has
    seq[np.arange(len(h)) + row] = index.ids(h)
    at = np.flatnonzero(seq)
    keep = np.zeros(len(at), bool)
    if len(index.pairs):
        pair = seq[at] << 32 | seq[at + 1]
        p = np.minimum(np.searchsorted(index.pairs, pair), len(index.pairs) - 1)
        keep |= index.pairs[p] == pair
    if len(index.heads):
        keep |= np.isin(seq[at], index.heads)
    at = at[keep]
    suffix = index.rows(np.lib.stride_tricks.sliding_window_view(seq, DEPTH)[at]) if len(at) else np.zeros(0, index.low.dtype)
    order = np.argsort(suffix, kind="stable")
    array, suffix = at[order], suffix[order]
    # Windows of more than DEPTH words are searched by their first DEPTH and compared on below.
    lo, hi = np.searchsorted(suffix, index.low, "left"), np.searchsorted(suffix, index.high, "right")
    got = np.flatnonzero(hi > lo)
    window = np.repeat(got, (hi - lo)[got])
    pos = array[_ranges(lo[got], hi[got])]
    for k in range(DEPTH, index.window):
        want = index.words[window, k]
        ok = (want == 0) | (seq[pos + k] == want)
        pos, window = pos[ok], window[ok]
    place, back = np.unique(pos, return_inverse=True)
    full = index.lengths(seq, place)[back]
    starts = offs[:-1] + np.arange(n)
    text = np.searchsorted(starts, pos, "right") - 1
    return {"text": text, "start": pos - starts[text] if len(pos) else pos, "size": index.size[window], "window": window, "full": full}


def covered(n: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of each text inside at least one match."""
    base = np.concatenate([[0], np.cumsum(n + 1)])
    step = np.zeros(int(base[-1]) + 1, np.int64)
    np.add.at(step, base[text] + start, 1)
    np.add.at(step, base[text] + start + size, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(step) > 0)])
    return inside[base[1:]] - inside[base[:-1]]


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


class Index:
    """The blocks of a benchmark, broadcast one by one. A worker keeps a single block; of several it holds one at a time."""

    def __init__(self, benchmark: DataFrame, item_id: str, text: str, window: int):
        sc = benchmark.sparkSession.sparkContext
        self.blocks: list[Broadcast] = [sc.broadcast(Items(b, window)) for b in _blocks(benchmark, item_id, text)]

    def __iter__(self) -> Iterator[Items]:
        if len(self.blocks) == 1:
            yield self.blocks[0].value
            return
        for b in self.blocks:
            yield b.value
            b.__dict__.pop("_value", None)  # read again from the executor's copy for the next shard


def _judged(index: Index, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """(words, words inside matches of any block, matches by block) of the texts of a shard."""
    h, offs = kernel.words(texts)
    found = []
    for items in index:
        m = shard_matches(items, h, offs)
        pairs = np.unique(np.stack([m["text"], items.set_of[m["window"]]], 1), axis=0) if len(m["text"]) else np.zeros((0, 2), np.int64)
        m["items"] = [(t, [items.names[i] for i in items.sets[s].tolist()]) for t, s in pairs.tolist()]
        found.append(m)
    n_words = np.diff(offs)
    return n_words, covered(n_words, *(np.concatenate([m[k] for m in found]) for k in ("text", "start", "size"))), found


SCHEMA = "n_words long, n_hit long, n_items long, items array<string>, longest_match long, match_start long"


def _scan(index: Index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(1), SHARD_BYTES):
                n_words, hit, found = _judged(index, texts)
                n = len(texts)
                items: list[set[str]] = [set() for _ in range(n)]
                for m in found:
                    for t, names in m["items"]:
                        items[t].update(names)
                names = [sorted(x) for x in items]
                text, start, full = (np.concatenate([m[k] for m in found]) for k in ("text", "start", "full"))
                longest, where = np.zeros(n, np.int64), np.full(n, -1)
                best = np.lexsort((-start, full, text))
                longest[text[best]], where[text[best]] = full[best], start[best]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int64()), pa.array(where, pa.int64(), mask=where < 0)],
                    names=["id", "n_words", "n_hit", "n_items", "items", "longest_match", "match_start"],
                )

    return scan


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list]:
    """The items in blocks of at most BLOCK_BYTES (one longer item is a block of its own), streamed to the driver."""
    block, size = [], 0
    for i, t in benchmark.select(item_id, text).toLocalIterator():
        if block and size + len(t or "") > BLOCK_BYTES // 4:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t or "")
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document: words, words inside benchmark windows, the items, longest match and whether it is contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. longest_match: words of the longest verbatim match with any item that starts
    where a window occurs (of a benchmark of several blocks, with any item of one block); match_start: where, the first of equals.
    A null or empty text has no words and is clean. A null item text has no window. Repeated documents and items give the same result for
    each; a null id stays null. Other columns of either table are ignored, whatever their names. An empty benchmark leaves every
    document clean; an empty table gives an empty result. Word equality is judged on 64-bit hashes.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"))
    kind = docs.schema[doc_id].dataType.simpleString()
    found = source.mapInArrow(_scan(Index(benchmark, item_id, item_text, window)), f"id {kind}, {SCHEMA}")
    return found.select(
        F.col("id").alias(doc_id), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "longest_match", "match_start",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, whole rows, decided where they stand: nothing is joined or shuffled.

    Each row is judged by its own text: ids may be null or repeat. Null and empty texts stay; an empty benchmark keeps every row; an empty
    table stays empty. Columns stay as they are.
    """
    index = Index(benchmark, item_id, item_text, window)
    where = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(where), SHARD_BYTES):
                n_words, hit, _ = _judged(index, texts)
                yield batch.slice(at, len(texts)).filter(pa.array((hit == 0) | (share * hit < n_words)))

    return docs.mapInArrow(keep, docs.schema)
