"""Searches over chunks: semantic, regular expression, phrase with BM25, hybrid, and lists by category.

Filters on projects, languages, categories and flags come before ranking and reach the scan; the top rows are taken per task first.
Query vectors are literals, so a chunk is read once and nothing is joined for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V

FLAGS = ["is_test", "is_config", "is_documentation", "is_resource"]


def filtered(rows: DataFrame, *, project: str | None = None, language: str | None = None, category: str | None = None, **flags: bool | None) -> DataFrame:
    """Only the predicates that are asked for; a flag of None asks for nothing."""
    if project is not None:
        rows = rows.filter(F.col("project_name") == project)
    if language:
        rows = rows.filter(F.col("language") == language)
    if category:
        rows = rows.filter(F.col("file_category") == category)
    for k, v in flags.items():
        if v is not None:
            if k not in FLAGS:
                raise ValueError(f"unknown flag {k}")
            rows = rows.filter(F.col(k) == v)
    return rows


def with_files(chunks: DataFrame, files: DataFrame, **filters) -> DataFrame:
    """Chunks of the files that pass. The filters apply to the file side before the join; only its columns needed are kept."""
    cols = ["project_name", F.col("path").alias("file_path"), "language", "file_category", *[c for c in FLAGS if c in files.columns]]
    few = filtered(files.select(*cols), **filters).select("project_name", "file_path", "language")
    left = chunks if filters.get("project") is None else chunks.filter(F.col("project_name") == filters["project"])
    return left.join(few, ["project_name", "file_path"])


def clamp(limit: int) -> int:
    return min(max(limit, 1), 100)


ORDER = ["file_path", "chunk_index"]


def similarity(vector: list[float], metric: str = "cosine", score: str = "cosine", column: str = "embedding", norm: str | None = None) -> Column:
    """The query's norm is computed once; a stored norm of the column saves a pass over each vector."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError("metric must be cosine or euclidean")
    q = V.literal(vector)
    if metric == "euclidean":
        return V.euclidean_score(F.col(column), q)
    cos = V.cosine(F.col(column), q, None if norm is None else F.col(norm), F.lit(math.sqrt(sum(float(x) * float(x) for x in vector))))
    return V.index_score(cos) if score == "index" else cos


def _asked(filters: dict) -> bool:
    return any(v for k, v in filters.items() if k not in FLAGS) or any(filters.get(k) is not None for k in FLAGS)


def semantic(chunks: DataFrame, files: DataFrame, vector: list[float], limit: int = 10, *, min_similarity: float | None = None, metric: str = "cosine", score: str = "cosine", postfilter: bool = False, **filters) -> DataFrame:
    """The chunks most like the vector. Where nothing but a project filters, chunks are ranked first and only the top ones meet their files (every
    chunk has its file, as the store writes both at once). With ``postfilter``, three times the limit are ranked over everything and
    filtered afterwards, so fewer or more rows than the limit may come back."""
    sim = similarity(vector, metric, score, norm="norm" if "norm" in chunks.columns else None)
    order = [F.desc("similarity"), *ORDER, "project_name"]
    rows = chunks.filter("embedding IS NOT NULL")
    if postfilter:
        return with_files(rows.withColumn("similarity", sim).orderBy(*order).limit(3 * limit), files, **filters)
    project = filters.pop("project", None)
    first = not _asked(filters)
    rows = filtered(rows, project=project) if first else with_files(rows, files, project=project, **filters)
    rows = rows.withColumn("similarity", sim)
    if min_similarity is not None:
        rows = rows.filter(F.col("similarity") > min_similarity)
    top = rows.orderBy(*order).limit(limit)
    return with_files(F.broadcast(top), files, project=project).orderBy(*order) if first else top  # a limit's worth of rows


#: Queries that are compared at once; of each, a task holds its best k.
QUERY_BLOCK = 2000


def semantic_many(chunks: DataFrame, queries: DataFrame, k: int = 5, *, block: int = QUERY_BLOCK) -> DataFrame:
    """The k chunks most like each of a stated set of vectors (query_id, vector), however many.

    Queries come to the driver and go to the executors in blocks of bounded size; every chunk meets each block as a matrix product, and a task
    lets k rows a query go on, which a salted window and a last one rank. Equal similarities (to 12 places) rank by chunk. Vectors that are
    null, of other lengths than a query's or hold a null don't rank; a query of length 0 has a similarity of 0 with all.
    """
    cosines, kind = None, chunks.schema["chunk_id"].dataType.simpleString()
    rows = chunks.filter("embedding IS NOT NULL").select("chunk_id", "embedding")
    for part in _blocks(queries, block):
        scored = rows.mapInArrow(_best(chunks.sparkSession.sparkContext.broadcast(part), k), f"query_id long, chunk_id {kind}, similarity double")
        cosines = scored if cosines is None else cosines.unionByName(scored)
    if cosines is None:
        return chunks.sparkSession.createDataFrame([], f"query_id long, rank int, chunk_id {kind}, similarity double")
    order = [F.desc(F.round("similarity", 12)), "chunk_id"]
    some = Window.partitionBy("query_id", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).orderBy(*order)
    few = cosines.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "similarity")


def _blocks(queries: DataFrame, block: int) -> Iterator[list[tuple[int, list[float]]]]:
    part: list[tuple[int, list[float]]] = []
    for r in queries.select("query_id", "vector").toLocalIterator():
        if r["vector"] is not None and None not in r["vector"]:
            part.append((r["query_id"], r["vector"]))
        if len(part) == block:
            yield part
            part = []
    if part:
        yield part


def _best(queries, k: int):
    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(v) for _, v in queries.value}:
            mine = [(i, v) for i, v in queries.value if len(v) == n]
            by_length[n] = np.array([i for i, _ in mine], np.int64), unit(np.array([v for _, v in mine], np.float64))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length of vector: similarities and chunks, a row a query
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            ids = np.array(batch.column(0).to_pylist(), object if pa.types.is_string(kind) else None)
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for n, (_, q) in by_length.items():
                at = np.flatnonzero(sizes == n)
                flat = batch.column(1).take(pa.array(at)).flatten()
                if not len(at) or n == 0:
                    continue
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                whole = ~np.isnan(x).any(1) if flat.null_count else np.ones(len(x), bool)
                x, names = unit(x[whole]), ids[at][whole]
                for a in range(0, len(x), 4096):
                    s, c = np.round(q @ x[a : a + 4096].T, 15), np.broadcast_to(names[a : a + 4096], (len(q), len(x[a : a + 4096])))
                    if n in held:
                        s, c = np.concatenate([held[n][0], s], 1), np.concatenate([held[n][1], c], 1)
                    top = np.lexsort((c, -np.round(s, 12)), axis=1)[:, :k] if c.dtype != object else np.array([sorted(range(s.shape[1]), key=lambda j, r=r: (-round(s[r, j], 12), c[r, j]))[:k] for r in range(len(s))])
                    held[n] = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        for n, (s, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(by_length[n][0], s.shape[1])), pa.array(c.ravel().tolist(), kind), pa.array(s.ravel())], names=["query_id", "chunk_id", "similarity"])

    return run


def by_regex(chunks: DataFrame, files: DataFrame, pattern: str, limit: int = 10, *, mode: str = "full", **filters) -> DataFrame:
    """Chunks whose whole content matches (full) or that hold a match (find), in path order."""
    if mode not in ("full", "find"):
        raise ValueError("mode must be full or find")
    test = T.full_match(F.col("content"), pattern) if mode == "full" else F.rlike("content", F.lit(pattern))
    return with_files(chunks.filter(test), files, **filters).withColumn("similarity", F.lit(1.0)).orderBy(*ORDER, "project_name").limit(limit)


def _phrase(words: list[str]) -> str:
    return " " + " ".join(words) + " "


def by_phrase(chunks: DataFrame, files: DataFrame, words: list[str], limit: int = 10, *, k1: float = 1.2, b: float = 0.75, **filters) -> DataFrame:
    """Chunks in which the words stand next to each other, ranked by BM25 with the phrase as the term.

    Frequencies and lengths are gathered over all chunks given, as one index holds all projects, in one aggregation of a row a task. Words are
    counted without being listed; only chunks that hold every word somewhere are cut into words.
    """
    spaced = F.concat(F.lit("  "), F.array_join(T.tokens(F.col("content")), "  "), F.lit("  "))
    lower = F.lower("content")
    maybe = reduce(lambda a, b: a & b, (F.contains(lower, F.lit(w)) for w in words))
    # Words are two spaces apart, so that neighbouring occurrences don't share one.
    term = F.lit(_phrase(words).replace(" ", "  ")[1:-1])
    tf = F.size(F.split(spaced, F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1)) - 1
    rows = chunks.withColumns({"_n": F.regexp_count("content", F.lit(r"[\p{L}\p{N}_]+")), "_f": F.when(maybe, tf).otherwise(0)})
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("avg"), F.count_if(F.col("_f") > 0).alias("df")).first()
    if not total["df"]:
        return with_files(chunks.limit(0), files, **filters).withColumn("similarity", F.lit(0.0))
    idf = math.log(1 + (total["n"] - total["df"] + 0.5) / (total["df"] + 0.5))
    score = idf * F.col("_f") * (k1 + 1) / (F.col("_f") + k1 * (1 - b + b * F.col("_n") / total["avg"]))
    found = rows.filter(F.col("_f") > 0).withColumn("similarity", score).drop("_n", "_f")
    return with_files(found, files, **filters).orderBy(F.desc("similarity"), *ORDER, "project_name").limit(limit)


def hybrid(vector_hits: DataFrame, phrase_hits: DataFrame, limit: int = 10, key: list[str] | None = None) -> DataFrame:
    """Two rankings as one: each score over its list's largest, the better of the two kept for a chunk in both."""
    key = key or ["project_name", "file_path", "chunk_index"]
    lists = []
    for hits in (vector_hits, phrase_hits):
        top = F.max("similarity").over(Window.partitionBy(F.lit(1)))  # a list is as long as its limit
        lists.append(hits.select(*key, F.when(top <= 0, 0.0).otherwise(F.col("similarity") / top).alias("score")))
    return lists[0].unionByName(lists[1]).groupBy(*key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), *key).limit(limit)


def by_category(files: DataFrame, category: str | None = None, limit: int = 100, enabled: bool = True, **filters) -> DataFrame:
    """Files of a category or with flags, in path order; none if classification is off."""
    cols = ["project_name", "path", "language", "size", "file_category", *FLAGS, "namespace"]
    rows = filtered(files, category=category, **filters).select(*cols)
    return rows.orderBy("path", "project_name").limit(limit if enabled else 0)


def projected(hits: DataFrame) -> DataFrame:
    """What a caller sees: content cut to 500 characters, the score to 3 places."""
    return hits.select("project_name", F.col("file_path").alias("file"), T.preview(F.col("content")).alias("content"), F.round("similarity", 3).alias("similarity"))


def previewed(hits: DataFrame, most: int = 10, chars: int = 200) -> DataFrame:
    """The first hits with the beginning of their content, for a text answer."""
    text = F.when(F.length("content") > chars, F.concat(F.substring("content", 1, chars), F.lit("..."))).otherwise(F.col("content"))
    return hits.limit(most).withColumn("preview", text)


def page(rows: DataFrame, by: list[str], skip: int, most: int) -> DataFrame:
    """Rows in an order that ``by`` fixes, some skipped, some taken."""
    return rows.orderBy(*by).offset(skip).limit(most)


def metadata_of(rows: DataFrame, leave: list[str]) -> Column:
    """All columns but some as a map of text, those that are null left out."""
    names = sorted(c for c in rows.columns if c not in leave)
    every = F.map_from_entries(F.array(*(F.struct(F.lit(c), F.col(c).cast("string")) for c in names)))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def metadata_search(rows: DataFrame, vector: list[float], top_k: int, where: dict[str, str] | None = None, *, compat: bool = False, column: str = "embedding", metadata: str = "metadata") -> DataFrame:
    """Vector search with equal metadata, filtered before ranking; with ``compat``, after."""
    rows = rows.filter(F.col(column).isNotNull()).withColumn("score", similarity(vector, column=column))
    keep = F.lit(True)
    for k, v in (where or {}).items():
        keep = keep & (F.col(metadata)[k] == v)
    rank = [F.desc("score"), "node_id"]
    if compat:
        return rows.orderBy(*rank).limit(top_k).filter(keep)
    return rows.filter(keep).orderBy(*rank).limit(top_k)


def metadata_test(metadata: Column, key: str, test: dict | str) -> Column:
    """Equality, or ``{"$contains": part}`` or ``{"$gt": number}``."""
    if not isinstance(test, dict):
        return metadata[key] == test
    ops = {"$contains": lambda v: F.contains(metadata[key], F.lit(v)), "$gt": lambda v: metadata[key].cast("double") > v}
    out = F.lit(True)
    for op, v in test.items():
        if op not in ops:
            raise ValueError(f"unknown operator {op}")
        out = out & ops[op](v)
    return out


def weighted_hybrid(sim: Column, meta: Column, vector_weight: float = 0.7) -> Column:
    return vector_weight * sim + (1 - vector_weight) * meta
