"""Chunks of files: by lines under a byte limit, by estimated tokens, and long lines split at natural breaks.

Files within the limit, nearly all, are one chunk each by a native expression; only the rest go through Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import CHUNK_BYTES

#: Fixed value: where a long line may break, most wanted first.
BREAKS = " ,;)}]>\t"


def size(text: str) -> int:
    return len(text.encode())


def _fit(line: str, start: int, most: int) -> int:
    """Characters from ``start`` that fit in ``most`` bytes, one at least."""
    end = min(len(line), start + most)
    while size(line[start:end]) > most:
        over = size(line[start:end]) - most
        end -= max(1, over // 4)
    while end < len(line) and end - start < most and size(line[start : end + 1]) <= most:
        end += 1
    return max(1, end - start)


def split_large_line(line: str, most: int = CHUNK_BYTES) -> list[str]:
    """Lossless parts of at most ``most`` bytes, broken after the last break in the final tenth of a part, if there is one."""
    if size(line) <= most:
        return [line]
    out, start = [], 0
    while start < len(line):
        n = _fit(line, start, most)
        end = start + n
        if end < len(line):
            low = start + int(n * 0.9)
            end = next((k + 1 for c in BREAKS if (k := line.rfind(c, low, end)) > start), end)
        out.append(line[start:end])
        start = end
    return out


def chunk_spans(content: str, chunk_size: int = 500, overlap: int = 50, most: int = CHUNK_BYTES, compat: bool = False) -> list[tuple[str, int, int]]:
    """(chunk, first line, last line). Windows of whole lines overlap; a line beyond the limit is split where it stands, without overlap.

    With ``compat`` the window goes on sliding when it has reached the end, by one line at least; otherwise it stops there.
    """
    if size(content) <= most:
        return [(content, 1, content.count("\n") + 1)]
    lines = content.split("\n")
    if len(lines) == 1:
        return [(c, 1, 1) for c in split_large_line(content, most)]
    sizes = [size(x) for x in lines]
    out, i = [], 0
    while i < len(lines):
        if sizes[i] > most:
            out += [(c, i + 1, i + 1) for c in split_large_line(lines[i], most)]
            i += 1
            continue
        total, j = -1, i
        while j < min(len(lines), i + chunk_size) and total + 1 + sizes[j] <= most:
            total += 1 + sizes[j]
            j += 1
        out.append(("\n".join(lines[i:j]), i + 1, j))
        if not compat and j == len(lines):
            break
        i += max(1, j - i - overlap)
    return out


def chunk_content(content: str, chunk_size: int = 500, overlap: int = 50, compat: bool = False) -> list[str]:
    return [c for c, _, _ in chunk_spans(content, chunk_size, overlap, compat=compat)]


def chunk_by_tokens(content: str, max_tokens: int = 2000, overlap_tokens: int = 200, most: int = CHUNK_BYTES) -> list[str]:
    """Chunks by five characters a token; the next chunk starts with the last lines that hold ``overlap_tokens``."""
    chars, overlap = min(max_tokens * 5, most // 3), overlap_tokens * 5
    out: list[str] = []
    held: list[str] = []
    for line in content.split("\n"):
        if size(line) > most:
            out += split_large_line(line, most)
            continue
        if held and (sum(map(len, held)) + len(line) > chars or size("\n".join([*held, line])) > most):
            out.append("\n".join(held))
            keep = n = 0
            for keep, prev in enumerate(reversed(held), 1):
                n += len(prev)
                if n >= overlap:
                    break
            held = held[-keep:]
        held.append(line)
    if held:
        out += split_large_line("\n".join(held), most)
    return out or (split_large_line(content, most) if content else [])


CHUNK = "array<struct<chunk_index:int,content:string,start_line:int,end_line:int>>"


def chunk_files(files: DataFrame, key: list[str], content: str = "content", chunk_size: int = 500, overlap: int = 50, compat: bool = False) -> DataFrame:
    """Key, chunk_index, content, start_line, end_line. A null content has no chunks.

    With ``compat`` a chunk's start line is counted by steps of the window, and its end line equals it.
    """
    small = F.octet_length(content) <= CHUNK_BYTES
    end = F.lit(1) if compat else F.size(F.split(content, "\n"))
    one = files.filter(small).select(*key, F.lit(0).alias("chunk_index"), F.col(content).alias("content"), F.lit(1).alias("start_line"), end.cast("int").alias("end_line"))
    step = chunk_size - overlap

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            for row, text in enumerate(batch.column(n).to_pylist()):
                spans = chunk_spans(text, chunk_size, overlap, compat=compat)
                if compat:
                    spans = [(c, 1 + k * step, 1 + k * step) for k, (c, _, _) in enumerate(spans)]
                cols = [pa.array([batch.column(k)[row].as_py()] * len(spans), batch.column(k).type) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(range(len(spans)), pa.int32()), pa.array([s[0] for s in spans]), pa.array([s[1] for s in spans], pa.int32()), pa.array([s[2] for s in spans], pa.int32())], names=[*batch.schema.names[:n], "chunk_index", "content", "start_line", "end_line"])

    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in key)
    rest = files.filter(~small).select(*key, content).mapInArrow(cut, f"{kinds}, chunk_index int, content string, start_line int, end_line int")
    return one.unionByName(rest)


def chunk_by_token_rows(files: DataFrame, key: list[str], content: str = "content", max_tokens: int = 2000, overlap_tokens: int = 200) -> DataFrame:
    """Key, chunk_index, content. Files of no more characters than a chunk holds are one chunk by a native expression."""
    chars = min(max_tokens * 5, CHUNK_BYTES // 3)
    small = (F.length(content) <= chars) & (F.octet_length(content) <= CHUNK_BYTES)
    one = files.filter(small).select(*key, F.lit(0).alias("chunk_index"), F.col(content).alias("content"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            for row, text in enumerate(batch.column(n).to_pylist()):
                parts = chunk_by_tokens(text, max_tokens, overlap_tokens)
                cols = [pa.array([batch.column(k)[row].as_py()] * len(parts), batch.column(k).type) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=[*batch.schema.names[:n], "chunk_index", "content"])

    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in key)
    return one.unionByName(files.filter(~small).select(*key, content).mapInArrow(cut, f"{kinds}, chunk_index int, content string"))
