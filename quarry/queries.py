"""Every query of the engine by name, and its SQL for DuckDB.

The SQL states each result independently of the engine; common table expressions at the top mirror ``plans.adapt``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import metrics as M
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import changes, chunking, complexity, detection, profiling, search, stats
from quarry.plans import adapt
from quarry.registry import ORACLE, QUERIES, query  # noqa: F401
from quarry.streaming import changes as streaming

RAW = """raw AS (
  SELECT source AS project_name, 'src/' || lang || '/' || CASE doc_id % 6 WHEN 0 THEN 'test_' WHEN 1 THEN 'config_' WHEN 3 THEN 'readme_' ELSE '' END || 'doc_' || doc_id
    || CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.md' WHEN 3 THEN '.sql' WHEN 4 THEN '.yaml' WHEN 5 THEN '.kt' ELSE '.ts' END AS path,
    text AS content, CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id, lang
  FROM documents)"""
FILES = (
    RAW
    + """, flagged AS (
  SELECT *, regexp_extract(path, '[^/]*$') AS filename,
    CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'markdown' WHEN 3 THEN 'sql' WHEN 4 THEN 'yaml' WHEN 5 THEN 'kotlin' ELSE 'typescript' END AS language,
    contains(path, 'test_') AS is_test, contains(regexp_extract(path, '[^/]*$'), 'config') OR path LIKE '%.yaml' AS is_config,
    path LIKE '%.sql' AS is_resource, path LIKE '%.md' OR contains(regexp_extract(path, '[^/]*$'), 'readme') AS is_documentation
  FROM raw), files AS (
  SELECT *, CASE WHEN is_test THEN 'test' WHEN is_config THEN 'config' WHEN is_resource THEN 'resource' WHEN is_documentation THEN 'documentation' ELSE 'source' END AS file_category,
    CASE WHEN language IN ('python', 'typescript') THEN lang WHEN language = 'java' THEN nullif(regexp_extract(content, '(?m)^\\s*package\\s+([a-zA-Z0-9_.]+)\\s*;', 1), '') END AS namespace
  FROM flagged)"""
)
CHUNKS = """chunks AS (
  SELECT r.project_name, r.path AS file_path, CAST(e.vec_id % 2 AS INTEGER) AS chunk_index,
    CASE WHEN e.vec_id % 2 = 0 THEN substr(r.content, 1, length(r.content) // 2) ELSE substr(r.content, length(r.content) // 2 + 1) END AS content,
    CAST(e.embedding AS DOUBLE[]) AS embedding, e.label, e.vec_id AS chunk_id
  FROM embeddings e JOIN raw r ON r.doc_id = e.vec_id // 2)"""
STATES = """day AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 50 AS INTEGER)) AS t FROM raw),
indexed AS (SELECT project_name, path, t AS last_modified FROM day WHERE doc_id % 11 <> 0),
current AS (SELECT project_name, path, t + to_days(CASE doc_id % 9 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS last_modified FROM day WHERE doc_id % 13 <> 0),
status AS (
  SELECT coalesce(c.project_name, i.project_name) AS project_name, coalesce(c.path, i.path) AS path,
    CASE WHEN i.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' WHEN c.last_modified > i.last_modified THEN 'modified' ELSE 'unchanged' END AS status
  FROM current c FULL JOIN indexed i ON c.project_name = i.project_name AND c.path = i.path)"""
CHANGES = "ev AS (SELECT 'src/file_' || user_id || '.py' AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, ts, event_id, value FROM events)"
FILTERED = "cf AS (SELECT c.*, f.language, f.file_category, f.is_test, f.is_config, f.is_documentation, f.is_resource FROM chunks c JOIN files f ON c.project_name = f.project_name AND c.file_path = f.path)"


def _files(s, d):
    return adapt.code_files(s, d)


def _chunks(s, d):
    return adapt.code_chunks(s, d)


def _query_vector(s: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in adapt.table(s, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]


Q0 = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"
COS = "list_dot_product(c.embedding, q.v) / (sqrt(list_dot_product(c.embedding, c.embedding)) * sqrt(list_dot_product(q.v, q.v)))"
LE = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
WS = "[\\s\\x1c-\\x1f\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"

# ---- files: classification, text functions


@query(f"WITH {FILES} SELECT project_name, path, filename, language, is_test, is_config, is_resource, is_documentation, file_category, namespace FROM files")
def file_classification(s, d):
    return _files(s, d).select("project_name", "path", "filename", "language", "is_test", "is_config", "is_resource", "is_documentation", "file_category", "namespace")


@query(f"WITH {FILES} SELECT project_name, file_category, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM files GROUP BY ALL")
def file_category_counts(s, d):
    return _files(s, d).groupBy("project_name", "file_category").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))


@query(f"SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, '{LE}')) + CASE WHEN regexp_matches(text, '(?:{LE})\\z') THEN 0 ELSE 1 END END AS INTEGER) AS lines, sha256(text) AS content_sha256, octet_length(encode(text)) AS size FROM documents")
def line_counts_and_hashes(s, d):
    t = F.col("text")
    return adapt.table(s, d, "documents").select("doc_id", T.line_count(t).alias("lines"), F.sha2(t, 256).alias("content_sha256"), F.octet_length(t).cast("long").alias("size"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(text, '{WS}', ' ', 'g'), ' ')) AS sanitized_md5 FROM documents")
def sanitize_content(s, d):
    return adapt.table(s, d, "documents").select("doc_id", F.md5(T.sanitize(F.col("text"))).alias("sanitized_md5"))


@query("""SELECT item_id, '"' || replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' AS phrase,
  regexp_replace(text, '(&&|\\|\\||[-+!(){}\\[\\]^"~*?:\\\\/])', '\\\\\\\\\\1', 'g') AS escaped FROM benchmark""")
def escape_queries(s, d):
    t = F.col("text")
    return adapt.table(s, d, "benchmark").select("item_id", T.phrase_quote(t).alias("phrase"), T.escape_query(t).alias("escaped"))


def _sequential_sql() -> str:
    out = "replace(replace(url, '&&', '\\&&'), '||', '\\||')"
    for c in T.SPECIALS:
        out = f"replace({out}, '{c}', '\\\\{c}')"
    return f"SELECT page_id, replace({out}, '->', '\\\\->') AS escaped FROM pages"


@query(_sequential_sql())
def escape_queries_sequential(s, d):
    return adapt.table(s, d, "pages").select("page_id", T.escape_query(F.col("url"), sequential=True).alias("escaped"))


@query("SELECT doc_id, round(list_sum(list_transform(range(0, 16), lambda i: CAST(('0x' || substr(md5(text), 31 - 2 * CAST(i AS INTEGER), 2)) AS INTEGER) / 255.0 * (i + 1))), 6) AS weighted_sum FROM documents")
def md5_embedding(s, d):
    v = V.md5_embedding(F.col("text"))
    total = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return adapt.table(s, d, "documents").select("doc_id", F.round(total, 6).alias("weighted_sum"))


@query("SELECT page_id, substr(regexp_replace(trim(url), '[^a-zA-Z0-9_-]', '_', 'g'), 1, 100) AS project, regexp_full_match(trim(url), '[a-zA-Z0-9_-]{1,100}') AS valid FROM pages")
def project_names(s, d):
    u = F.col("url")
    return adapt.table(s, d, "pages").select("page_id", T.project_name(u).alias("project"), T.valid_project_name(u).alias("valid"))


# ---- statistics

STATS = "per AS (SELECT project_name, file_path AS path, count(*) AS n FROM chunks GROUP BY ALL)"
_STATS_SQL = "WITH {files}, {chunks}, {stats} SELECT f.project_name, count(DISTINCT f.path) AS total_files, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_chunks, CAST(sum(size{fan}) AS BIGINT) AS total_size, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM files f LEFT JOIN per p ON f.project_name = p.project_name AND f.path = p.path GROUP BY f.project_name"


@query(_STATS_SQL.format(files=FILES, chunks=CHUNKS, stats=STATS, fan=""))
def repo_stats(s, d):
    return stats.repository_stats(_files(s, d), _chunks(s, d))


@query(_STATS_SQL.format(files=FILES, chunks=CHUNKS, stats=STATS, fan=" * greatest(coalesce(n, 0), 1)"))
def repo_stats_fanout(s, d):
    return stats.repository_stats(_files(s, d), _chunks(s, d), fanout=True)


@query(f"WITH {FILES}, g AS (SELECT project_name, language, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM files GROUP BY ALL) SELECT *, round(size * 100.0::DOUBLE / sum(size) OVER (PARTITION BY project_name), 2) AS percentage FROM g")
def language_breakdown(s, d):
    return stats.language_breakdown(_files(s, d))


@query(f"WITH {FILES}, r AS (SELECT project_name, CAST(row_number() OVER (PARTITION BY project_name ORDER BY size DESC, path) AS INTEGER) AS rank, path, language, size FROM files) SELECT * FROM r WHERE rank <= 5")
def largest_files(s, d):
    return stats.largest_files(_files(s, d))


@query(f"WITH {FILES}, {CHUNKS}, {STATS} SELECT f.project_name, f.path, language, size, file_category, coalesce(n, 0) AS chunk_count, coalesce(n, 0) > 0 AS indexed FROM files f LEFT JOIN per p ON f.project_name = p.project_name AND f.path = p.path")
def file_metadata(s, d):
    return stats.file_metadata(_files(s, d), _chunks(s, d)).select("project_name", "path", "language", "size", "file_category", "chunk_count", "indexed")


@query(f"WITH {RAW}, {STATES} SELECT c.project_name, count(*) AS monitored, count(i.path) AS indexed, round(count(i.path) * 100.0::DOUBLE / count(*), 2) AS coverage FROM current c LEFT JOIN indexed i ON c.project_name = i.project_name AND c.path = i.path GROUP BY c.project_name")
def index_health(s, d):
    current, indexed = adapt.snapshots(s, d)
    return stats.index_health(current, indexed)


@query(f"WITH {FILES} SELECT project_name, path, language, size, file_category, is_test, is_config, is_documentation, is_resource, namespace FROM files WHERE file_category = 'source' AND is_test = false ORDER BY path, project_name LIMIT 100")
def list_by_category(s, d):
    return search.by_category(_files(s, d), "source", is_test=False)


# ---- changes and keyed writes


@query(f"WITH {RAW}, {STATES} SELECT * FROM status")
def change_detection(s, d):
    return changes.change_status(*adapt.snapshots(s, d))


@query(f"WITH {RAW}, {STATES} SELECT project_name, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'unchanged') AS unchanged FROM status GROUP BY project_name")
def incremental_summary(s, d):
    return changes.summary(changes.change_status(*adapt.snapshots(s, d)))


@query(f"WITH {RAW}, {STATES} SELECT c.project_name, c.path, c.last_modified FROM current c JOIN status s ON c.project_name = s.project_name AND c.path = s.path WHERE s.status IN ('new', 'modified')")
def files_to_index(s, d):
    return changes.to_index(*adapt.snapshots(s, d)).select("project_name", "path", "last_modified")


@query(f"WITH {RAW}, {STATES} SELECT coalesce(c.project_name, i.project_name) AS project_name, coalesce(c.path, i.path) AS path, coalesce(c.last_modified, i.last_modified) AS last_modified FROM current c FULL JOIN indexed i ON c.project_name = i.project_name AND c.path = i.path")
def upsert_files(s, d):
    current, indexed = adapt.snapshots(s, d)
    return changes.upsert(indexed, current).select("project_name", "path", "last_modified")


def _doomed(s, d):
    return adapt.raw_files(s, d).filter("doc_id % 5 = 0").select("project_name", "path")


@query(f"WITH {RAW}, {CHUNKS}, gone AS (SELECT project_name, path FROM raw WHERE doc_id % 5 = 0) SELECT g.project_name, g.path, 'success' AS status, count(c.chunk_id) AS chunks_removed FROM gone g LEFT JOIN chunks c ON g.project_name = c.project_name AND g.path = c.file_path GROUP BY ALL")
def delete_files(s, d):
    return changes.delete_files(adapt.raw_files(s, d), _chunks(s, d), _doomed(s, d))[2]


@query(f"WITH {RAW}, {CHUNKS} SELECT c.project_name, c.file_path, c.chunk_index FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.doc_id % 5 = 0 AND r.project_name = c.project_name AND r.path = c.file_path)")
def remove_files(s, d):
    return changes.delete_files(adapt.raw_files(s, d), _chunks(s, d), _doomed(s, d))[1].select("project_name", "file_path", "chunk_index")


@query(f"WITH {RAW}, {CHUNKS} SELECT project_name, file_path, chunk_index, length(content) AS chars FROM chunks WHERE (chunk_id // 2) % 5 <> 0 UNION ALL SELECT project_name, path, 0, length(content) FROM raw WHERE doc_id % 5 = 0")
def replace_chunks(s, d):
    new = adapt.raw_files(s, d).filter("doc_id % 5 = 0").select("project_name", F.col("path").alias("file_path"), F.lit(0).alias("chunk_index"), F.length("content").cast("long").alias("chars"))
    old = _chunks(s, d).select("project_name", "file_path", "chunk_index", F.length("content").cast("long").alias("chars"))
    return changes.replace_chunks(old, _doomed(s, d), new)


@query(f"WITH {RAW}, o AS (SELECT project_name, path, md5(content) AS h FROM raw WHERE doc_id % 4 <> 0), n AS (SELECT project_name, path, md5(CASE WHEN doc_id % 3 = 0 THEN content || '!' ELSE content END) AS h FROM raw) SELECT n.project_name, n.path, CASE WHEN o.path IS NULL THEN 'added' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS action FROM n LEFT JOIN o ON n.project_name = o.project_name AND n.path = o.path")
def refresh_by_hash(s, d):
    f = adapt.raw_files(s, d)
    new = f.select("project_name", "path", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("hash"))
    old = f.filter("doc_id % 4 <> 0").select("project_name", "path", F.md5("content").alias("hash"))
    return changes.by_hash(new, old)


@query("WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.text = n.text THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def chunk_vector_diff(s, d):
    t = adapt.table(s, d, "documents")
    new = t.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))
    return changes.chunk_diff(t.filter("doc_id % 7 <> 0"), new, "doc_id", "text")


@query("SELECT vec_id AS node_id, vec_id AS position, CASE WHEN vec_id % 10 = 3 THEN 'failed' ELSE 'success' END AS status, CASE WHEN vec_id % 10 = 3 THEN 'expected 64 dimensions' END AS error FROM embeddings")
def batch_upsert_status(s, d):
    e = adapt.table(s, d, "embeddings")
    cut = F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return changes.checked_vectors(e.select(F.col("vec_id").alias("node_id"), F.col("vec_id").alias("position"), cut.alias("vector")), 64)


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) > 8000")
def oversized_chunks(s, d):
    t = adapt.table(s, d, "documents").select(F.lit("p").alias("project_name"), F.lit("f").alias("file_path"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    return changes.oversized(t, 8000).select(F.col("chunk_index").alias("doc_id"), F.col("chars").cast("long").alias("chars"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || chr(10) || '... [TRUNCATED - content too large]' ELSE text END) AS content_md5 FROM documents")
def truncate_chunks(s, d):
    t = adapt.table(s, d, "documents").select("doc_id", F.col("text").alias("content"))
    return changes.truncated(t, 8000).select("doc_id", F.md5("content").alias("content_md5"))


# ---- vectors and searches

_TOP = "SELECT chunk_id, project_name, file_path, chunk_index, round({score}, 6) AS similarity FROM {rows} c, q {where} ORDER BY {score} DESC, file_path, chunk_index, project_name LIMIT {n}"
_COLS = ["chunk_id", "project_name", "file_path", "chunk_index"]


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_COLS, F.round("similarity", 6).alias("similarity"))


@query(f"WITH {FILES}, {CHUNKS}, {FILTERED}, {Q0} " + _TOP.format(score=COS, rows="cf", where="", n=10))
def cosine_topk(s, d):
    return _shown(search.semantic(_chunks(s, d), _files(s, d), _query_vector(s, d), 10))


@query(f"WITH {FILES}, {CHUNKS}, {FILTERED}, {Q0} " + _TOP.format(score=COS, rows="cf", where=f"WHERE language = 'python' AND {COS} > 0.05", n=10))
def cosine_threshold(s, d):
    return _shown(search.semantic(_chunks(s, d), _files(s, d), _query_vector(s, d), 10, min_similarity=0.05, language="python"))


@query(f"WITH {FILES}, {CHUNKS}, {FILTERED}, {Q0} " + _TOP.format(score=f"(1 + {COS}) / 2", rows="cf", where="WHERE file_category = 'source'", n=10))
def index_score_topk(s, d):
    return _shown(search.semantic(_chunks(s, d), _files(s, d), _query_vector(s, d), 10, score="index", category="source"))


@query(f"WITH {FILES}, {CHUNKS}, {FILTERED}, {Q0} " + _TOP.format(score="1 / (1 + list_sum(list_transform(list_zip(c.embedding, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))", rows="cf", where="", n=10))
def euclidean_topk(s, d):
    return _shown(search.semantic(_chunks(s, d), _files(s, d), _query_vector(s, d), 10, metric="euclidean"))


@query(f"WITH {FILES}, {CHUNKS}, {FILTERED}, {Q0}, near AS (SELECT c.*, {COS} AS sim FROM cf c, q ORDER BY sim DESC, file_path, chunk_index, project_name LIMIT 30) SELECT chunk_id, project_name, file_path, chunk_index, round(sim, 6) AS similarity FROM near WHERE language = 'python'")
def postfilter_topk(s, d):
    return _shown(search.semantic(_chunks(s, d), _files(s, d), _query_vector(s, d), 10, postfilter=True, language="python"))


@query(f"WITH {RAW}, {CHUNKS}, qs AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {COS.replace('q.v', 'qs.v')} DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round({COS.replace('q.v', 'qs.v')}, 6) AS similarity FROM chunks c, qs) SELECT * FROM r WHERE rank <= 5")
def multi_query_topk(s, d):
    """The stated query set: every row whose id is divisible by 100, against all rows."""
    asked = adapt.table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.semantic_many(_chunks(s, d), asked, 5).withColumn("similarity", F.round("similarity", 6))


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, len(e) = 64 AS valid FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def normalize_vectors(s, d):
    e = F.col("embedding")
    return adapt.table(s, d, "embeddings").select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.normalize(e)[0], 6).alias("first"), V.valid_dims(e, 64).alias("valid"))


@query("SELECT CAST(label AS VARCHAR) AS label, count(embedding) AS vectors, 64 AS dimensions, 'cosine' AS similarity FROM embeddings GROUP BY label")
def index_stats(s, d):
    return adapt.table(s, d, "embeddings").groupBy(F.col("label").cast("string").alias("label")).agg(F.count("embedding").alias("vectors")).select("label", "vectors", F.lit(64).alias("dimensions"), F.lit("cosine").alias("similarity"))


def _nodes(s, d):
    e = adapt.table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("node_id"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("half"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")).alias("metadata"))


_NODES = f"{Q0}, c AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS embedding, label, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM embeddings), s AS (SELECT node_id, {COS} AS score, half FROM c, q)"


@query(f"WITH {_NODES} SELECT node_id, round(score, 6) AS score FROM s WHERE half = 'even' ORDER BY s.score DESC, node_id LIMIT 10")
def metadata_topk(s, d):
    return search.metadata_search(_nodes(s, d), _query_vector(s, d), 10, {"half": "even"}).select("node_id", F.round("score", 6).alias("score"))


@query(f"WITH {_NODES}, t AS (SELECT * FROM s ORDER BY score DESC, node_id LIMIT 10) SELECT node_id, round(score, 6) AS score FROM t WHERE half = 'even'")
def metadata_topk_postfilter(s, d):
    return search.metadata_search(_nodes(s, d), _query_vector(s, d), 10, {"half": "even"}, compat=True).select("node_id", F.round("score", 6).alias("score"))


@query("WITH q AS (SELECT list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * (CASE WHEN i <= 32 THEN 2.0 ELSE 0.5 END)) AS v FROM embeddings WHERE vec_id = 0), w AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * (CASE WHEN i <= 32 THEN 2.0 ELSE 0.5 END)) AS embedding FROM embeddings) SELECT vec_id, round(" + COS + ", 6) AS similarity FROM w c, q")
def weighted_cosine(s, d):
    weights = [2.0] * 32 + [0.5] * 32
    q = [x * w for x, w in zip(_query_vector(s, d), weights, strict=True)]
    return adapt.table(s, d, "embeddings").select("vec_id", F.round(V.cosine(V.weighted(F.col("embedding"), weights), V.literal(q)), 6).alias("similarity"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), j AS (SELECT a.vec_id, list_concat(list_transform(a.v, lambda x: x * 0.7::DOUBLE), list_transform(a.v, lambda x: x * (1 - 0.7::DOUBLE))) AS w FROM e a) SELECT vec_id, len(w) AS dims, round(w[1] / sqrt(list_dot_product(w, w)), 6) AS first, round(w[65] / sqrt(list_dot_product(w, w)), 6) AS middle FROM j")
def multimodal_embedding(s, d):
    w = V.combined(F.col("embedding"), F.col("embedding"))
    return adapt.table(s, d, "embeddings").select("vec_id", w.alias("w")).select("vec_id", F.size("w").cast("long").alias("dims"), F.round(F.col("w")[0], 6).alias("first"), F.round(F.col("w")[64], 6).alias("middle"))


@query(f"WITH {FILES}, {CHUNKS}, {FILTERED} SELECT chunk_id, project_name, file_path, chunk_index FROM cf WHERE regexp_full_match(content, '[A-Z][a-z]+ [a-z].*', 's') ORDER BY file_path, chunk_index, project_name LIMIT 50")
def regex_full(s, d):
    return search.by_regex(_chunks(s, d), _files(s, d), r"(?s)[A-Z][a-z]+ [a-z].*", 50).select(*_COLS)


@query(f"WITH {FILES}, {CHUNKS}, {FILTERED} SELECT chunk_id, project_name, file_path, chunk_index FROM cf WHERE regexp_matches(content, '[0-9]{{3}}-[0-9]{{4}}|@[a-z]') AND is_test = false ORDER BY file_path, chunk_index, project_name LIMIT 50")
def regex_find(s, d):
    return search.by_regex(_chunks(s, d), _files(s, d), r"[0-9]{3}-[0-9]{4}|@[a-z]", 50, mode="find", is_test=False).select(*_COLS)


_BM = """tok AS (SELECT c.*, ' ' || array_to_string(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS t FROM chunks c),
n AS (SELECT *, length(t) - length(replace(t, ' ', '')) - 1 AS n, CASE WHEN contains(t, ' of the ') THEN (length(replace(t, ' ', '  ')) - length(replace(replace(t, ' ', '  '), ' of  the ', ''))) // 9 ELSE 0 END AS f FROM tok),
tot AS (SELECT count(*) AS big_n, avg(n) AS avg_n, count(*) FILTER (f > 0) AS df FROM n)"""
_BM_SCORE = "ln(1 + (big_n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n.n / avg_n))"


@query(f"WITH {FILES}, {CHUNKS}, {_BM}, s AS (SELECT n.*, {_BM_SCORE} AS score FROM n, tot WHERE f > 0) SELECT s.chunk_id, s.project_name, s.file_path, s.chunk_index, round(score, 6) AS similarity FROM s JOIN files fl ON s.project_name = fl.project_name AND s.file_path = fl.path WHERE fl.language <> '' ORDER BY score DESC, s.file_path, s.chunk_index, s.project_name LIMIT 20")
def phrase_search(s, d):
    return _shown(search.by_phrase(_chunks(s, d), _files(s, d), ["of", "the"], 20))


@query(f"WITH {FILES}, {CHUNKS}, {Q0}, {_BM}, p AS (SELECT n.project_name, n.file_path, n.chunk_index, {_BM_SCORE} AS s FROM n, tot WHERE f > 0 ORDER BY s DESC, file_path, chunk_index, project_name LIMIT 20), v AS (SELECT c.project_name, c.file_path, c.chunk_index, {COS} AS s FROM chunks c, q ORDER BY s DESC, file_path, chunk_index, project_name LIMIT 20), u AS (SELECT project_name, file_path, chunk_index, s / max(s) OVER () AS s FROM p UNION ALL SELECT project_name, file_path, chunk_index, s / max(s) OVER () FROM v) SELECT project_name, file_path, chunk_index, round(max(s), 6) AS score FROM u GROUP BY ALL ORDER BY max(s) DESC, project_name, file_path, chunk_index LIMIT 15")
def hybrid_search(s, d):
    c, f = _chunks(s, d), _files(s, d)
    out = search.hybrid(search.semantic(c, f, _query_vector(s, d), 20), search.by_phrase(c, f, ["of", "the"], 20), 15)
    return out.withColumn("score", F.round("score", 6))


@query(f"WITH {FILES}, {CHUNKS}, {FILTERED}, {Q0}, t AS (SELECT c.*, {COS} AS sim FROM cf c, q ORDER BY sim DESC, file_path, chunk_index, project_name LIMIT 10) SELECT project_name, file_path AS file, CASE WHEN length(content) > 500 THEN substr(content, 1, 497) || '...' ELSE content END AS content, round(sim, 3) AS similarity FROM t")
def search_projection(s, d):
    return search.projected(search.semantic(_chunks(s, d), _files(s, d), _query_vector(s, d), search.clamp(10)))


# ---- metrics: part sizes and quantities stand for counts

_METRIC = "m AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS cc, CAST(l_quantity * 7 AS INTEGER) % 300 AS loc, l_discount AS cr, l_linenumber AS n1, CAST(l_quantity AS INTEGER) % 13 AS n2, l_linenumber * 3 AS t1, CAST(l_quantity AS INTEGER) AS t2 FROM lineitem)"


def _metric_rows(s, d):
    q = F.col("l_quantity").cast("int")
    return adapt.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("cc"), ((F.col("l_quantity") * 7).cast("int") % 300).alias("loc"), F.col("l_discount").alias("cr"), F.col("l_linenumber").alias("n1"), (q % 13).alias("n2"), (F.col("l_linenumber") * 3).alias("t1"), q.alias("t2"))


_MI = "CASE WHEN loc = 0 THEN 100.0 ELSE least(greatest(171 - 0.23::DOUBLE * cc - 16.2::DOUBLE * ln(loc::DOUBLE) + CASE WHEN cr > 0 THEN 50 * sin(sqrt(2.4::DOUBLE * cr)) ELSE 0 END, 0), 100) END"


@query(f"WITH {_METRIC}, x AS (SELECT *, {_MI} AS mi FROM m) SELECT l_orderkey, l_linenumber, round(mi, 6) AS mi, CASE WHEN mi >= 80 THEN 'A' WHEN mi >= 60 THEN 'B' WHEN mi >= 40 THEN 'C' WHEN mi >= 20 THEN 'D' ELSE 'F' END AS grade, CASE WHEN cc <= 5 THEN 'A' WHEN cc <= 10 THEN 'B' WHEN cc <= 20 THEN 'C' WHEN cc <= 30 THEN 'D' ELSE 'F' END AS cc_grade, CASE WHEN cc <= 5 THEN 'simple' WHEN cc <= 10 THEN 'moderate' WHEN cc <= 20 THEN 'complex' ELSE 'very-complex' END AS classification FROM x")
def maintainability_grades(s, d):
    x = _metric_rows(s, d).withColumn("mi", M.maintainability(F.col("cc"), F.col("loc"), F.col("cr")))
    return x.select("l_orderkey", "l_linenumber", F.round("mi", 6).alias("mi"), M.grade_of_maintainability(F.col("mi")).alias("grade"), M.grade_of_complexity(F.col("cc")).alias("cc_grade"), M.classification(F.col("cc")).alias("classification"))


@query(f"WITH {_METRIC} SELECT l_orderkey, l_linenumber, round(CASE WHEN n1 + n2 <= 0 THEN 0 ELSE (t1 + t2) * log2((n1 + n2)::DOUBLE) END, 6) AS volume, round(CASE WHEN n2 = 0 THEN 0 ELSE n1 / 2.0::DOUBLE * (t2::DOUBLE / n2) END, 6) AS difficulty FROM m")
def halstead(s, d):
    c = {k: F.col(k) for k in ("n1", "n2", "t1", "t2")}
    return _metric_rows(s, d).select("l_orderkey", "l_linenumber", F.round(M.halstead_volume(c["n1"], c["n2"], c["t1"], c["t2"]), 6).alias("volume"), F.round(M.halstead_difficulty(c["n1"], c["n2"], c["t2"]), 6).alias("difficulty"))


@query(f"WITH {_METRIC} SELECT l_orderkey, l_linenumber, round(0.35::DOUBLE * least(cc / 30.0::DOUBLE * 100, 100) + 0.35::DOUBLE * least(t1 / 25.0::DOUBLE * 100, 100) + 0.2::DOUBLE * least(n1 / 6.0::DOUBLE * 100, 100) + 0.1::DOUBLE * least(loc / 200.0::DOUBLE * 100, 100), 6) AS risk, 1 + n1 + CASE WHEN cc % 2 = 1 AND n1 > 0 THEN 1 ELSE 0 END AS increment FROM m")
def risk_and_cognitive_increment(s, d):
    x = _metric_rows(s, d)
    risk = M.risk_score(F.col("cc"), F.col("t1"), F.col("n1"), F.col("loc"))
    return x.select("l_orderkey", "l_linenumber", F.round(risk, 6).alias("risk"), M.cognitive_increment(F.col("n1"), F.col("cc") % 2 == 1).alias("increment"))


def _count_sql(part: str) -> str:
    return f"(length(text) - length(replace(text, '{part}', ''))) // {len(part)}"


@query("SELECT doc_id, " + " + ".join(map(_count_sql, M.LOGICAL)) + " AS operators FROM documents")
def logical_operators(s, d):
    return adapt.table(s, d, "documents").select("doc_id", M.logical_operators(F.col("text")).cast("long").alias("operators"))


# ---- profiles: events as operations

_OPS = "op AS (SELECT event_type AS operation, user_id % 20 AS grp, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, value FROM events)"


def _ops(s, d):
    e = adapt.table(s, d, "events")
    return e.select(F.col("event_type").alias("operation"), (F.col("user_id") % 20).alias("grp"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("s"), "value")


@query(f"WITH {_OPS}, t AS (SELECT grp, s AS a, s + value * 100 AS b FROM op), m AS (SELECT grp, a AS t, 1 AS d FROM t UNION ALL SELECT grp, b, -1 FROM t), r AS (SELECT grp, sum(d) OVER (PARTITION BY grp ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM m), x AS (SELECT grp, max(n) AS n FROM r GROUP BY grp) SELECT t.grp, count(*) AS tasks, CAST(any_value(x.n) AS BIGINT) AS max_concurrent FROM t JOIN x ON t.grp = x.grp GROUP BY t.grp")
def max_concurrency(s, d):
    t = _ops(s, d).select("grp", F.col("s").alias("start"), (F.col("s") + F.col("value") * 100).alias("end"))
    return profiling.max_concurrency(t, "grp").select("grp", "tasks", F.col("max_concurrent").cast("long").alias("max_concurrent"))


@query(f"WITH {_OPS}, u AS (SELECT *, CASE WHEN value > lag(value) OVER (PARTITION BY grp ORDER BY s, event_id) THEN 1 ELSE 0 END AS up FROM op), i AS (SELECT *, sum(1 - up) OVER (PARTITION BY grp ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM u), r AS (SELECT grp, isl, sum(up) AS run FROM i GROUP BY ALL), g AS (SELECT grp, max(run) AS longest_rise FROM r GROUP BY grp), p AS (SELECT grp, count(*) AS n, max(value) AS peak, arg_min(event_id, (-value, s, event_id)) AS peak_label FROM op GROUP BY grp) SELECT g.grp, CAST(longest_rise AS BIGINT) AS longest_rise, n, peak, peak_label, longest_rise > 0.7 * n AS leak FROM g JOIN p ON g.grp = p.grp")
def increase_runs(s, d):
    rows = _ops(s, d).withColumn("at", F.struct("s", "event_id"))
    return profiling.increase_runs(rows, "grp", "at", "value", "event_id", time="s")


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN value > 100 THEN 'slow_execution' END, CASE WHEN user_id % 100 > 80 THEN 'high_cpu' END, CASE WHEN value * 2 > 100 THEN 'high_memory' END], lambda x: x IS NOT NULL), ',') AS issues FROM events WHERE value > 50 OR user_id % 100 > 80")
def bottlenecks(s, d):
    e = adapt.table(s, d, "events").select("event_id", F.col("value").alias("duration_ms"), (F.col("user_id") % 100).alias("cpu"), (F.col("value") * 2).alias("memory_mb"))
    return profiling.bottlenecks(e).select("event_id", "issues")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev(value), 6) AS stdev, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS min, max(value) AS max, count(*) FILTER (value > 50) AS slow FROM events GROUP BY event_type")
def latency_percentiles(s, d):
    return stats.latency_stats(adapt.table(s, d, "events"), "event_type", "value", slow=50)


@query("SELECT event_type, count(*) FILTER (value > 20) AS hits, count(*) FILTER (NOT value > 20) AS misses, round(count(*) FILTER (value > 20) / (count(*) FILTER (value > 20) + count(*) FILTER (NOT value > 20)), 6) AS hit_rate FROM events GROUP BY event_type")
def cache_hit_rate(s, d):
    return stats.hit_rate(adapt.table(s, d, "events").withColumn("hit", F.col("value") > 20), ["event_type"], "hit")


# ---- change streams


@query(f"WITH {CHANGES} SELECT path, arg_max(change_type, (ts, change_type)) AS change_type, max(ts) AS ts FROM ev GROUP BY path")
def latest_changes(s, d):
    return streaming.latest(adapt.change_events(s, d))


@query(f"WITH {CHANGES} SELECT path, change_type, ts, event_id FROM ev ORDER BY ts DESC, event_id DESC LIMIT 5")
def recent_changes(s, d):
    return streaming.recent(adapt.change_events(s, d))


@query(f"WITH {CHANGES} SELECT CAST(ts AS DATE) AS day, change_type, count(*) AS changes, count(DISTINCT path) AS paths, max(ts) AS last FROM ev GROUP BY ALL")
def changes_per_day(s, d):
    return streaming.per_day(adapt.change_events(s, d))


# ---- language detection, chunks, complexity

_EXT = "CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'markdown' WHEN 3 THEN 'sql' WHEN 4 THEN 'yaml' WHEN 5 THEN 'kotlin' ELSE 'typescript' END"


def _boost_sql(language: str) -> str:
    return "0.5::DOUBLE + " + " + ".join("CASE WHEN " + " OR ".join(f"contains(text, '{p}')" for p in parts) + f" THEN {gain}::DOUBLE ELSE 0 END" for parts, gain in detection.BOOSTS[language])


@query(f"SELECT doc_id, {_EXT} AS language, 0.7::DOUBLE AS confidence, " + ", ".join(f"round(least(1.0::DOUBLE, {_boost_sql(g)}), 6) AS {g}" for g in detection.BOOSTS) + " FROM documents")
def language_extension_and_boosts(s, d):
    t = adapt.table(s, d, "documents").withColumn("r", detection.by_extension(adapt.file_path(F.col("doc_id"), F.col("lang"))))
    return t.select("doc_id", "r.language", "r.confidence", *(F.round(detection.adjusted(F.col("text"), g, F.lit(0.5)), 6).alias(g) for g in detection.BOOSTS))


@query()
def language_detect(s, d):
    return detection.detect_files(adapt.raw_files(s, d), ["doc_id"])


@query("SELECT doc_id, 0 AS chunk_index, md5(text) AS content_md5, 1 AS start_line, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line FROM documents WHERE octet_length(encode(text)) <= 30000")
def chunk_small_files(s, d):
    small = adapt.table(s, d, "documents").filter(F.octet_length("text") <= T.CHUNK_BYTES)
    return chunking.chunk_files(small, ["doc_id"], "text").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), "start_line", "end_line")


@query()
def chunk_content(s, d):
    """Every document as one file, whole."""
    return chunking.chunk_files(adapt.table(s, d, "documents"), ["doc_id"], "text").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), "start_line", "end_line")


@query()
def complexity_of_documents(s, d):
    """Most documents aren't sources: they are reported as errors, none stops the run."""
    files = _files(s, d).filter(F.col("language").isin("python", "java", "kotlin"))
    got = complexity.summary(complexity.analyze_files(files, ["project_name", "path"]), ["project_name", "path"])
    return got.select("project_name", "path", "language", "error", "total_complexity", "complexity_grade")


# ---- measures of detection and tuning, documented extensions


@query(f"WITH {_METRIC}, x AS (SELECT *, {_MI} AS mi FROM m) SELECT l_orderkey, l_linenumber, CASE WHEN mi > 20 THEN 'good' WHEN mi >= 10 THEN 'moderate' ELSE 'poor' END AS mi_band, CASE WHEN cc <= 5 THEN 'simple' WHEN cc <= 10 THEN 'moderate' WHEN cc <= 20 THEN 'complex' WHEN cc <= 30 THEN 'very complex' ELSE 'extremely complex' END AS band, CASE WHEN cc <= 5 THEN 'A' WHEN cc <= 10 THEN 'B' WHEN cc <= 20 THEN 'C' WHEN cc <= 30 THEN 'D' WHEN cc <= 40 THEN 'E' ELSE 'F' END AS rank FROM x")
def documented_bands(s, d):
    x = _metric_rows(s, d).withColumn("mi", M.maintainability(F.col("cc"), F.col("loc"), F.col("cr")))
    return x.select("l_orderkey", "l_linenumber", M.documented_mi_band(F.col("mi")).alias("mi_band"), M.documented_band(F.col("cc")).alias("band"), M.rank_of_complexity(F.col("cc")).alias("rank"))


@query(f"WITH {_NODES}, m AS (SELECT *, CASE WHEN half LIKE '%ve%' THEN 1.0 ELSE 0.0 END AS meta FROM s) SELECT node_id, round(0.7::DOUBLE * score + (1 - 0.7::DOUBLE) * meta, 6) AS score FROM m WHERE node_id % 10 > 4")
def metadata_operators(s, d):
    rows = _nodes(s, d).withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("digit"), (F.col("node_id") % 10).cast("string"))))
    rows = rows.filter(search.metadata_test(F.col("metadata"), "digit", {"$gt": 4}))
    meta = F.when(search.metadata_test(F.col("metadata"), "half", {"$contains": "ve"}), 1.0).otherwise(0.0)
    return rows.select("node_id", F.round(search.weighted_hybrid(search.similarity(_query_vector(s, d)), meta), 6).alias("score"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(text, '{WS}', ' ', 'g'), ' ')) AS sanitized_md5 FROM documents WHERE list_max(list_transform(string_split_regex(text, '{WS}'), lambda w: octet_length(encode(w)))) > 24")
def oversized_terms(s, d):
    t = adapt.table(s, d, "documents").select("doc_id", F.col("text").alias("content"))
    return changes.long_terms(t, 24).select("doc_id", F.md5(T.sanitize(F.col("content"))).alias("sanitized_md5"))


@query("SELECT event_id, least(CASE WHEN value < 10 THEN 1000 WHEN value < 100 THEN 100 ELSE 10 END, user_id) AS batch FROM events")
def batch_sizes(s, d):
    return adapt.table(s, d, "events").select("event_id", profiling.batch_size(F.col("value"), F.col("user_id")).cast("long").alias("batch"))


@query("SELECT event_type, count(*) AS operations, round(sum(value), 4) AS total_ms, arg_max(event_id, (value, -event_id)) AS slowest, max(value) AS slowest_ms FROM events GROUP BY event_type")
def profile_report(s, d):
    e = adapt.table(s, d, "events").select("event_type", F.col("event_id").alias("operation"), F.col("value").alias("duration_ms"))
    return profiling.report(e, "event_type").withColumn("total_ms", F.round("total_ms", 4))


@query()
def chunk_by_tokens(s, d):
    return chunking.chunk_by_token_rows(adapt.table(s, d, "documents"), ["doc_id"], "text").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("SELECT doc_id, round(len(list_filter(regexp_extract_all(text, '[A-Za-z_]+'), lambda w: w IN ('def', 'class', 'import', 'self', 'lambda'))) / greatest(len(regexp_extract_all(text, '[A-Za-z_]+')), 1), 6) AS python, round(len(list_filter(regexp_extract_all(text, '[A-Za-z_]+'), lambda w: w IN ('public', 'class', 'void', 'static', 'extends'))) / greatest(len(regexp_extract_all(text, '[A-Za-z_]+')), 1), 6) AS java FROM documents")
def keyword_shares(s, d):
    return adapt.table(s, d, "documents").select("doc_id", *(F.round(detection.keyword_share(F.col("text"), g), 6).alias(g) for g in ("python", "java")))


@query(f"WITH {CHANGES}, g AS (SELECT path, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY path ORDER BY ts, event_id) AS gap FROM ev) SELECT path, event_id, gap FROM g WHERE gap IS NOT NULL")
def change_gaps(s, d):
    return streaming.gaps(adapt.change_events(s, d)).filter("gap IS NOT NULL").select("path", "event_id", "gap")


@query(f"WITH {FILES}, {CHUNKS}, {FILTERED} SELECT to_json({{'project': project_name, 'file': file_path, 'line': chunk_index}}) AS structured_content FROM cf")
def tool_json(s, d):
    rows = search.with_files(_chunks(s, d), _files(s, d))
    return rows.select(F.to_json(F.struct(F.col("project_name").alias("project"), F.col("file_path").alias("file"), F.col("chunk_index").alias("line"))).alias("structured_content"))


from quarry import queries_service, queries_sources  # noqa: E402, F401
