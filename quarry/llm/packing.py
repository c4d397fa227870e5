"""Best-fit packing of whole documents into sequences, by best-two-fit.

Every document is tokenised and ended by an end mark; only one longer than a sequence is cut, into full pieces and a last shorter one. A
sequence is filled greedily with the longest unpacked piece that fits; then its smallest document is replaced by the two unpacked
documents that together fit the gap it leaves more tightly. Which pieces go together depends on
their lengths alone, and there are no more than ``SIZE`` different lengths. So the packing is made on the table of counts by length,
at most SIZE rows at any scale: equal fillings are made as one pattern with a multiplicity. Each piece's rank among those of its length,
counted in parallel with salted groups, then tells its sequence and offset. The result is that of packing all pieces in
one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import kernel
from quarry.llm.bpe import WordBpe
from quarry.llm.cluster import checkpoint

SIZE, END = 4096, 1
#: Rows that share a length and a salt, on average at most. Salts follow each length's own count, so there are no more groups than
#: lengths and a row for every so many pieces.
SALT_ROWS = 250


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One encoder a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


@dataclass(frozen=True)
class Patterns:
    """Fillings: how many sequences each has, and of every length the ranks it takes with their places."""

    first: np.ndarray  # sequence number from which each pattern's sequences run
    copies: np.ndarray
    slots: dict[int, list[tuple[int, int, int, int]]]  # length -> (first rank, sequences, first sequence, offset)


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> Patterns:
    """Pack counts[length] pieces of each length (1 to size)."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(size + 1, np.int64)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    first, copies, sequence = [], [], 0
    live = np.flatnonzero(left)
    while len(live):
        take: list[int] = []
        gap, avail = size, left.copy()
        while len(live):
            k = int(np.searchsorted(live, gap, "right")) - 1
            while k >= 0 and avail[live[k]] == 0:
                k -= 1
            if k < 0:
                break
            length = int(live[k])
            take.append(length)
            avail[length] -= 1
            gap -= length
        if gap and len(take) > 1:
            pair = _two(avail, gap + take[-1], take[-1])
            if pair:
                take[-1:] = pair
        need, n = np.unique(take, return_counts=True)
        m = int((left[need] // n).min())
        at = 0
        for length in take:
            slots.setdefault(length, []).append((int(used[length]), m, sequence, at))
            used[length] += m
            at += length
        left[need] -= n * m
        first.append(sequence)
        copies.append(m)
        sequence += m
        live = live[left[live] > 0]
    return Patterns(np.array(first, np.int64), np.array(copies, np.int64), slots)


def _two(avail: np.ndarray, room: int, least: int) -> list[int]:
    """The two unpacked lengths with the largest sum up to room, if it beats least."""
    here = np.flatnonzero(avail[: room + 1])
    if not len(here):
        return []
    partner = np.searchsorted(here, room - here, "right") - 1
    a, b = here[partner >= 0], here[partner[partner >= 0]]
    single = (a == b) & (avail[a] < 2)  # a length with one piece left takes the next shorter partner
    lower = partner[partner >= 0] - 1
    b = np.where(single, np.where(lower >= 0, here[np.maximum(lower, 0)], 0), b)
    ok = b > 0
    a, b = a[ok], b[ok]
    if not len(a):
        return []
    k = int(np.argmax(a + b))
    return sorted([int(a[k]), int(b[k])], reverse=True) if a[k] + b[k] > least else []


def _pieces(path: str, size: int, end: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(1), 2 << 20):
                rows, piece, length, crc, ids = [], [], [], [], []
                for k, found in enumerate(encode(texts.to_pylist())):
                    found += last
                    for p, a in enumerate(range(0, len(found), 4 * size)):
                        part = found[a : a + 4 * size]
                        rows.append(at + k)
                        piece.append(p)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array([p * size for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return cut


def cut_pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(_pieces(path or vocabulary(), size, end, with_ids), schema)


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A null or empty text is its end mark alone. Repeated rows are documents of their own. Null ids stay null. An empty table packs
    into nothing. Other columns are ignored, whatever their names.
    """
    cut = checkpoint(cut_pieces(docs, doc_id=doc_id, text=text, path=path, size=size, end=end, with_ids=with_ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows at most
    plan = best_two_fit(counts, size)
    salts = docs.sparkSession.createDataFrame([(length, -(-n // SALT_ROWS)) for length, n in counts.items()], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    ranks = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")).cast("long") - 1)
    base = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    base = base.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "base")
    ranks = ranks.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("k"))
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    lookup = {length: tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) for length, s in plan.slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for z in np.unique(length):
                at = np.flatnonzero(length == z)
                low, _, seq, off = lookup[int(z)]
                s = np.searchsorted(low, rank[at], "right") - 1
                sequence[at], offset[at] = seq[s] + rank[at] - low[s], off[s]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = ranks.select(*names, "rank").mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", doc_id)
