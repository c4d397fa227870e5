"""Token counts that follow edits: pre-token segment trees per document.

A text is cut into pre-tokens, ``LEAF`` of them to a leaf, and a segment tree over the leaves keeps their token counts. An edit re-encodes
from the start of the leaf before it (what stands before an edit can join it or change its white space) to the first later leaf
border that is a pre-token border again; nothing beyond can change, as pre-tokens are found left to right. The new counts go into the
first leaf of that stretch, its other leaves become empty, and the sums above are updated.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernel, pii
from quarry.llm.bpe import LETTER, PLAIN

LEAF = 32
_FAST = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter(dict):
    """Token counts by pre-token, remembered for ``most`` of them at once."""

    def __init__(self, path: str, most: int = 200_000):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.rule = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.most = regex.compile(public_tokenizers.PATTERN), most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = len(self.rule.encode_ordinary(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def cut(self, text: str, at: int = 0) -> list[str]:
        """Pre-tokens from a pre-token border on."""
        if at == 0:
            return _FAST.findall(text) if PLAIN.fullmatch(text) else self.pattern.findall(text)
        return (_FAST if PLAIN.fullmatch(text) else self.pattern).findall(text, at)

    def pieces(self, text: str, at: int, plain: bool) -> Iterator[tuple[int, int]]:
        for m in (_FAST if plain else self.pattern).finditer(text, at):
            yield m.end(), self[m.group()]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


class Tree:
    """Leaf ends (code points) and a heap of sums: node 1 is the whole, leaf k is node ``width + k``."""

    def __init__(self, ends: list[int], sums: list[int]):
        self.ends, self.sums, self.width = ends, sums, len(sums) // 2

    @classmethod
    def of(cls, text: str, count: Counter, leaf: int = LEAF) -> Tree:
        pre = count.cut(text)
        tokens = list(map(count.__getitem__, pre))
        leaves = [sum(tokens[k : k + leaf]) for k in range(0, len(tokens), leaf)]
        ends, at = [], 0
        for k in range(0, len(pre), leaf):
            at += sum(map(len, pre[k : k + leaf]))
            ends.append(at)
        width = 1
        while width < len(leaves):
            width *= 2
        sums = [0] * width + leaves + [0] * (width - len(leaves))
        for k in range(width - 1, 0, -1):
            sums[k] = sums[2 * k] + sums[2 * k + 1]
        return cls(ends, sums)

    @property
    def total(self) -> int:
        return self.sums[1]

    def put(self, leaf: int, tokens: int) -> None:
        k, change = self.width + leaf, tokens - self.sums[self.width + leaf]
        while k and change:
            self.sums[k] += change
            k //= 2

    def edit(self, old: str, edits: list[tuple[int, int, str]], count: Counter) -> tuple[str, int]:
        """Apply sorted, non-overlapping (start, end, replacement) edits; returns the new text and how many tokens were encoded for it."""
        parts, at, marks = [], 0, []
        for start, end, new in edits:
            parts += [old[at:start], new]
            marks.append((start, end, len(new) - (end - start)))
            at = end
        text = "".join([*parts, old[at:]])
        if not edits:
            return text, 0
        if not self.ends:
            fresh = Tree.of(text, count)
            self.ends, self.sums, self.width = fresh.ends, fresh.sums, fresh.width
            return text, self.total
        plain = bool(PLAIN.fullmatch(text))
        done, encoded, k, shift = 0, 0, 0, 0  # shift: of the old text's places, by edits already behind
        ends = list(self.ends)
        while k < len(marks):
            first = min(bisect_right(self.ends, max(marks[k][0] - 1, 0)), len(self.ends) - 1)
            first = max(first - 1, done) if first else 0
            while first > done and self.ends[first] == self.ends[first - 1]:  # emptied by an earlier edit: it holds no border of a pre-token
                first -= 1
            start = (self.ends[first - 1] if first else 0) + shift
            now, tokens, leaf, moved = start, 0, first, shift
            resumed = False
            for now, n in count.pieces(text, start, plain):
                tokens, encoded = tokens + n, encoded + n
                while k < len(marks) and marks[k][0] + moved <= now:  # edits that this pre-token has reached
                    moved += marks[k][2]
                    k += 1
                if k and now < marks[k - 1][1] + moved:
                    continue
                while leaf < len(self.ends) and self.ends[leaf] + moved < now:
                    leaf += 1
                if leaf < len(self.ends) and self.ends[leaf] + moved == now and (not k or self.ends[leaf] > marks[k - 1][1] or self.ends[leaf] == len(old)):
                    if k == len(marks) or self.ends[leaf] < marks[k][0]:
                        resumed = True
                        break
            if not resumed:
                leaf = len(self.ends) - 1
                moved += sum(m[2] for m in marks[k:])
                k = len(marks)
            self.put(first, tokens)
            for j in range(first + 1, leaf + 1):
                self.put(j, 0)
            for j in range(first, leaf + 1):
                ends[j] = now if resumed else len(text)
            shift, done = moved, leaf + 1
            nxt = marks[k][0] if k < len(marks) else len(old) + 1
            for j in range(leaf + 1, len(self.ends)):
                if self.ends[j] > nxt:
                    break
                ends[j] = self.ends[j] + shift
        for j in range(done, len(self.ends)):
            ends[j] = self.ends[j] + shift
        self.ends = ends
        return text, encoded


def masks(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query: personal data of the base kinds, replaced by the names of their kinds."""
    out: list[tuple[int, int, str]] = []
    upto = 0
    found = pii.base_spans(text) if pii._MARKED.search(text) else {}
    for start, end, kind in sorted((s, e, k) for k, spans in found.items() for s, e in spans):
        if start >= upto:
            out.append((start, end, f"<{kind}>"))
            upto = end
    return out


def token_trees(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: n_tokens, leaf_ends and sums, to be kept beside the text for later edits. A null text is empty."""
    where = path or vocabulary()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(where)
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(1)):
                trees = [Tree.of(t or "", count) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([t.total for t in trees], pa.int64()), pa.array([t.ends for t in trees], pa.list_(pa.int32())), pa.array([t.sums for t in trees], pa.list_(pa.int32()))], names=["id", "n_tokens", "leaf_ends", "sums"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(build, f"id {kind}, n_tokens long, leaf_ends array<int>, sums array<int>").withColumnRenamed("id", doc_id)


def edit_trees(trees: DataFrame, edits: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Stored trees with edits applied: doc_id, text, n_tokens, leaf_ends, sums, n_edits, n_encoded, ready to be stored again.

    trees: ``token_trees`` beside the text that each was built from. edits: rows (doc_id, start, end, replacement), places in code points of
    the stored text. Only the leaves around an edit are encoded again. Edits of a document go in order of their places; one that
    overlaps the one before it, has a null place, or reaches beyond the text is left out, and n_edits counts the others. A
    null replacement is empty. Documents without edits come back as they are; edits without a document change nothing. Rows that repeat an
    id all get its edits; rows without an id get none. Other columns of either table are ignored. Empty tables give what there is.
    """
    where = path or vocabulary()
    kind = trees.schema[doc_id].dataType.simpleString()
    some = edits.select(F.col(doc_id).cast(kind).alias("__id"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce(F.col("replacement").cast("string"), F.lit("")).alias("new")).alias("e"))
    # A document's edits are apart, so there are no more of them than it has characters.
    some = some.filter("__id IS NOT NULL AND e.start IS NOT NULL AND e.end IS NOT NULL AND e.start >= 0 AND e.end >= e.start").groupBy("__id").agg(F.array_sort(F.collect_set("e")).alias("__edits"))
    rows = trees.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), "n_tokens", "leaf_ends", "sums").join(some, F.col("id") == F.col("__id"), "left").drop("__id")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(where)
        for batch in batches:
            out: list[tuple] = []
            for _, t, n, ends, sums, todo in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if not todo:
                    out.append((t, n, ends, sums, 0, 0))
                    continue
                apart: list[tuple[int, int, str]] = []
                for e in todo:
                    if e["end"] <= len(t) and (not apart or e["start"] >= apart[-1][1] and (e["start"], e["end"]) != apart[-1][:2]):
                        apart.append((e["start"], e["end"], e["new"]))
                tree = Tree(list(ends), list(sums))
                new, encoded = tree.edit(t, apart, count)
                out.append((new, tree.total, tree.ends, tree.sums, len(apart), encoded))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
            cols = [pa.array(list(c), x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], x) for x in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "text", "n_tokens", "leaf_ends", "sums", "n_edits", "n_encoded"])

    return rows.mapInArrow(apply, f"id {kind}, text string, n_tokens long, leaf_ends array<int>, sums array<int>, n_edits long, n_encoded long").withColumnRenamed("id", doc_id)


def count_edited(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, edits=masks) -> DataFrame:
    """One row per document: n_tokens, n_edits, n_tokens_edited and n_encoded (tokens encoded again for the edits).

    ``edits`` maps a text to sorted, non-overlapping (start, end, replacement). A null or empty text has no tokens. Repeated
    rows count alike; a null id stays null. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    where = path or vocabulary()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(where)
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(1)):
                rows: list[tuple[int, int, int, int]] = []
                for t in texts.to_pylist():
                    tree = Tree.of(t or "", count)
                    before, todo = tree.total, edits(t or "")
                    encoded = tree.edit(t or "", todo, count)[1] if todo else 0
                    rows.append((before, len(todo), tree.total, encoded))
                cols = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n_tokens", "n_edits", "n_tokens_edited", "n_encoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_encoded long"
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(scan, schema).withColumnRenamed("id", doc_id)
