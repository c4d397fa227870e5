"""Queries on what surrounds a search: paths, previews, paging, caches, batches, logs of changes, embeddings, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import metrics as M
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import batches, caching, changes, chunking, complexity, detection, profiling, search, stats
from quarry.plans import adapt
from quarry.plans.embedding import HashProvider, embed
from quarry.plans.samples import SEGMENTS
from quarry.queries_sources import SAMPLES, _analyzed, _sources
from quarry.registry import query
from quarry.sources import scan
from quarry.sources.shared import fresh
from quarry.streaming import changes as streaming

# ---- complexity: options, bands, checks of results


def _plain(values: list[int]) -> str:
    return " + ".join(f"((bits >> {k}) & 1) * {v}" for k, v in enumerate(values))


#: Decision points of the Python segments where comprehensions and lambdas don't count; and cognitive cost where an elif nests no deeper.
_PLAIN_CC = _plain([2, 2, 2, 1, 2, 2, 0, 0, 0, 0])


@query(f"WITH {SAMPLES} SELECT doc_id, CASE marked WHEN 1 THEN 1 ELSE 1 + {_PLAIN_CC} END AS complexity, {_plain([s.cognitive for s in SEGMENTS['python']])} + ((bits >> 5) & 1) AS cognitive FROM sample WHERE part = 0")
def python_plain_measures(s, d):
    rows = complexity.functions(_analyzed(s, d, python={"variant": "plain"}), ["doc_id"])
    return rows.filter("language = 'python' AND name = concat('f', doc_id)").select("doc_id", "complexity", "cognitive")


#: Deepest indentation of a segment inside its function, in steps of four.
_DEEP = [3, 2, 3, 2, 3, 1, 1, 1, 3, 1]


@query(f"WITH {SAMPLES} SELECT doc_id, greatest(1, {', '.join(f'((bits >> {k}) & 1) * {v}' for k, v in enumerate(_DEEP))}) AS depth, 1 + cc + marked + 2 * greatest(0, greatest(1, {', '.join(f'((bits >> {k}) & 1) * {v}' for k, v in enumerate(_DEEP))}) - 1) AS estimate FROM sample WHERE part = 0")
def python_indentation(s, d):
    rows = complexity.functions(_analyzed(s, d, python={"indentation": True}), ["doc_id"]).filter("language = 'python' AND name = concat('f', doc_id)")
    return rows.select("doc_id", "depth", M.cognitive_estimate(F.col("complexity"), F.col("depth")).alias("estimate"))


@query(f"WITH {SAMPLES} SELECT doc_id, name, coalesce(parent_class, '') AS parent, CASE WHEN parent_class IS NULL THEN name ELSE parent_class || '.' || name END AS qualified FROM cls WHERE language = 'python'")
def class_hierarchy(s, d):
    rows = complexity.classes(_analyzed(s, d), ["doc_id"]).filter("language = 'python'")
    return complexity.hierarchy(rows, ["doc_id"]).select("doc_id", "name", "parent", "qualified")


@query(f"WITH {SAMPLES} SELECT c.doc_id, c.name AS class_name, f.name AS method, f.complexity FROM cls c JOIN fun f ON c.doc_id = f.doc_id AND f.line_start BETWEEN c.line_start AND c.line_end QUALIFY row_number() OVER (PARTITION BY f.doc_id, f.name, f.line_start ORDER BY c.line_start DESC) = 1")
def class_methods(s, d):
    a = _analyzed(s, d)
    return complexity.class_methods(complexity.classes(a, ["doc_id"]), complexity.functions(a, ["doc_id"]), ["doc_id"]).select("doc_id", "class_name", "method", "complexity")


@query(f"WITH {SAMPLES}, e AS (SELECT doc_id, 'class' AS kind, name, line_start FROM cls UNION ALL SELECT doc_id, type, name, line_start FROM fun) SELECT * FROM e WHERE name LIKE '%f%'")
def code_elements(s, d):
    return complexity.elements(_analyzed(s, d), ["doc_id"]).filter(F.contains("name", F.lit("f"))).select("doc_id", "kind", "name", "line_start")


_RES = "r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) - 3 AS cc, CAST(l_quantity AS INTEGER) - 2 AS cog, l_discount * 1200 AS mi, l_tax * 15 AS cr, l_quantity * 1.5 AS av, CAST(l_quantity AS INTEGER) % 3 AS fn, CAST(l_quantity AS INTEGER) AS loc FROM lineitem)"


@query(f"""WITH {_RES} SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN cc < 0 THEN 'total_complexity below 0' END, CASE WHEN cog < 0 THEN 'cognitive_complexity below 0' END, CASE WHEN mi > 100 THEN 'maintainability_index above 100' END, CASE WHEN cr > 1 THEN 'comment_ratio above 1' END, CASE WHEN fn = 1 AND cc < 1 THEN 'f: complexity below 1' END, CASE WHEN fn = 1 AND cog < 0 THEN 'f: cognitive below 0' END], lambda x: x IS NOT NULL), '; ') AS issues,
array_to_string(list_filter([CASE WHEN av > 50 THEN 'average_complexity above 50' END, CASE WHEN fn = 0 AND loc > 10 THEN 'more than 10 lines and no function' END], lambda x: x IS NOT NULL), '; ') AS warnings, NOT (cc < 0 OR cog < 0 OR mi > 100 OR cr > 1 OR fn = 1 AND (cc < 1 OR cog < 0)) AS is_valid FROM r""")
def complexity_validation(s, d):
    q = F.col("l_quantity").cast("int")
    f = F.struct(F.lit("f").alias("name"), (q - 3).alias("complexity"), (q - 2).alias("cognitive"))
    rows = adapt.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (q - 3).alias("total_complexity"), (q - 2).alias("cognitive_complexity"), (F.col("l_discount") * 1200).alias("maintainability_index"), (F.col("l_tax") * 15).alias("comment_ratio"), (F.col("l_quantity") * 1.5).alias("average_complexity"), (q % 3).alias("function_count"), q.alias("lines_of_code"), F.when(q % 3 == 1, F.array(f)).otherwise(F.slice(F.array(f), 1, 0)).alias("functions"))
    got = complexity.validation(rows)
    return got.select("l_orderkey", "l_linenumber", F.array_join("issues", "; ").alias("issues"), F.array_join("warnings", "; ").alias("warnings"), "is_valid")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN 'simple' WHEN l_quantity <= 20 THEN 'moderate' ELSE 'complex' END AS cyclomatic, CASE WHEN l_quantity * 2 <= 15 THEN 'simple' WHEN l_quantity * 2 <= 30 THEN 'moderate' WHEN l_quantity * 2 <= 60 THEN 'complex' ELSE 'extreme' END AS cognitive, CASE WHEN l_quantity * 2 >= 80 THEN 'excellent' WHEN l_quantity * 2 >= 60 THEN 'good' WHEN l_quantity * 2 >= 40 THEN 'fair' WHEN l_quantity * 2 >= 20 THEN 'poor' ELSE 'extreme' END AS maintainability FROM lineitem")
def complexity_bands(s, d):
    q = F.col("l_quantity")
    return adapt.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", complexity.banded(q, "cyclomatic").alias("cyclomatic"), complexity.banded(q * 2, "cognitive").alias("cognitive"), complexity.banded(q * 2, "maintainability").alias("maintainability"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) + l_linenumber + CAST(l_discount * 100 AS INTEGER) AS points, 1 + CAST(l_quantity AS INTEGER) + l_linenumber + CAST(l_discount * 100 AS INTEGER) AS complexity FROM lineitem")
def decision_points(s, d):
    p = M.decision_points(F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.round(F.col("l_discount") * 100).cast("int"))
    return adapt.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("points"), (p + 1).alias("complexity"))


@query("SELECT doc_id, round((doc_id % 4 + 2 * (doc_id % 3)) / (doc_id % 4 + 2 * (doc_id % 3) + doc_id % 5 + 1), 6) AS ratio FROM documents")
def comment_shares(s, d):
    n = F.col("doc_id")
    code = F.concat(F.repeat(F.lit("# x\n"), (n % 4).cast("int")), F.repeat(F.lit("/* a\n b */\n"), (n % 3).cast("int")), F.repeat(F.lit("code()\n"), (n % 5).cast("int")), F.lit("end"))
    return adapt.table(s, d, "documents").select("doc_id", F.round(M.comment_ratio(code), 6).alias("ratio"))


@query(f"WITH {SAMPLES} SELECT doc_id, '{{\"total_complexity\":' || total || ',\"average_complexity\":' || CAST(round(total / functions, 2) AS DOUBLE) || ',\"comment_ratio\":' || CAST(round(1 / lines, 3) AS DOUBLE) || '}}' AS report FROM graded WHERE NOT broken")
def rounded_report(s, d):
    rows = complexity.summary(_analyzed(s, d), ["doc_id"]).filter("error IS NULL")
    return rows.select("doc_id", F.to_json(complexity.rounded(["total_complexity", "average_complexity", "comment_ratio"])).alias("report"))


# ---- detection


_VOTE = "CASE WHEN n = 0 THEN 'unknown' ELSE language END AS language, CASE WHEN n = 0 THEN 0 ELSE round(least(0.6 + n / 50.0::DOUBLE, 0.85::DOUBLE), 6) END AS confidence"


def _vote_sql(source: str) -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{name}' AS language, len(list_filter(string_split(text, chr(10))[1:50], lambda x: regexp_matches(x, '{p}'))) AS n FROM {source}" for k, (name, p) in enumerate(detection.VOTES.items()))
    return f"v AS ({each}), best AS (SELECT doc_id, n, language FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) = 1) SELECT doc_id, {_VOTE} FROM best"


@query("WITH " + _vote_sql("documents"))
def language_votes(s, d):
    r = adapt.table(s, d, "documents").select("doc_id", detection.by_votes(F.col("text")).alias("r"))
    return r.select("doc_id", "r.language", F.round("r.confidence", 6).alias("confidence"))


@query(f"WITH {SAMPLES} SELECT doc_id, language, coalesce(total, 0) AS total_complexity FROM graded WHERE part < 2 AND NOT broken")
def detect_then_analyze(s, d):
    """The language comes from the content; broken sources and languages without a check of syntax are told by their paths."""
    src = _sources(s, d).filter("language <> 'kotlin' AND NOT startswith(content, '}')").drop("language")
    found = detection.detect_files(src, ["doc_id", "content"])
    return complexity.summary(complexity.analyze_files(found, ["doc_id"]), ["doc_id"]).select("doc_id", "language", "total_complexity")


@query(f"WITH {SAMPLES} SELECT count(*) AS files, 100.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1 FROM sample WHERE part < 2")
def detection_accuracy(s, d):
    """Detections of sources that are Python or Java, by content alone."""
    src = _sources(s, d).filter("language <> 'kotlin' AND NOT startswith(content, '}')")
    said = detection.detect_files(src.select("doc_id", "language", "content", F.lit(None).cast("string").alias("path")).withColumnRenamed("language", "truth"), ["doc_id", "truth"])
    return stats.accuracy(said, "truth", "language", "confidence").crossJoin(src.agg(F.count(F.lit(1)).alias("files"))).select("files", "accuracy", "f1")


_MEASURED = """r AS (SELECT CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'markdown' WHEN 3 THEN 'sql' WHEN 4 THEN 'yaml' WHEN 5 THEN 'kotlin' ELSE 'typescript' END AS t, doc_id FROM documents), q AS (SELECT t, CASE WHEN doc_id % 4 = 0 THEN 'python' ELSE t END AS p, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0.9 END AS c FROM r),
tr AS (SELECT t, count(*) AS n, count(*) FILTER (t = p) AS hit, count(*) FILTER (c >= 0.8) AS high FROM q GROUP BY t), sd AS (SELECT p AS t, count(*) AS said FROM q GROUP BY p),
e AS (SELECT tr.*, CASE WHEN coalesce(said, 0) = 0 THEN 0 ELSE hit / said END AS pr, hit / n AS re FROM tr LEFT JOIN sd ON tr.t = sd.t)
SELECT round(sum(hit) * 100 / sum(n), 4) AS accuracy, round(sum(high) * 100 / sum(n), 4) AS high_confidence, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END), 6) AS f1 FROM e"""


@query("WITH " + _MEASURED)
def accuracy_measures(s, d):
    """The measures themselves, on answers of which some are wrong by design."""
    f = adapt.code_files(s, d)
    f = f.select(F.col("language").alias("truth"), F.when(F.col("doc_id") % 4 == 0, "python").otherwise(F.col("language")).alias("said"), F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(0.9).alias("confidence"))
    return stats.accuracy(f, "truth", "said", "confidence")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' WHEN 2 THEN 'csharp' ELSE 'fortran' END AS language FROM documents")
def normalized_names(s, d):
    said = F.element_at(F.array(F.lit(" Python3 "), F.lit("C++"), F.lit("CS"), F.lit("Fortran")), (F.col("doc_id") % 4 + 1).cast("int"))
    return adapt.table(s, d, "documents").select("doc_id", detection.normalized(said).alias("language"))


@query("SELECT source, count(*) AS requests, count(DISTINCT text) AS misses, count(*) - count(DISTINCT text) AS hits, round((count(*) - count(DISTINCT text)) / count(*), 6) AS hit_rate FROM documents GROUP BY source")
def detection_cache(s, d):
    """What a cache by content does for a project's files."""
    rows = adapt.table(s, d, "documents").select("source", caching.cache_key(F.col("text")).alias("key"), F.length("text").alias("size"))
    return caching.requests(rows, ["source"], "key", "size").drop("average_size")


@query("SELECT source, round(avg(n), 6) AS average_size FROM (SELECT DISTINCT source, text, length(text) AS n FROM documents) GROUP BY source")
def cache_entry_sizes(s, d):
    rows = adapt.table(s, d, "documents").select("source", caching.cache_key(F.col("text")).alias("key"), F.length("text").alias("size"))
    return caching.requests(rows, ["source"], "key", "size").select("source", "average_size")


# ---- paths, projects, pages, previews


_PATHS = "p AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'src/a_' || doc_id || '.py' WHEN 1 THEN 'src/.hidden/x_' || doc_id || '.py' WHEN 2 THEN 'node_modules/m_' || doc_id || '.js' WHEN 3 THEN 'pkg/build/f_' || doc_id || '.py' WHEN 4 THEN 'lib/y_' || doc_id || '.js' WHEN 5 THEN 'lib/package-lock.json' WHEN 6 THEN 'b' || doc_id || '.pyc' WHEN 7 THEN 'deep/er/z_' || doc_id || '.py' ELSE 'notes_' || doc_id || '.txt' END AS path FROM documents)"


def _paths(s, d):
    n = F.col("doc_id").cast("string")
    made = [("src/a_", ".py"), ("src/.hidden/x_", ".py"), ("node_modules/m_", ".js"), ("pkg/build/f_", ".py"), ("lib/y_", ".js"), None, ("b", ".pyc"), ("deep/er/z_", ".py"), ("notes_", ".txt")]
    each = F.array(*(F.lit("lib/package-lock.json") if m is None else F.concat(F.lit(m[0]), n, F.lit(m[1])) for m in made))
    return adapt.table(s, d, "documents").select("doc_id", F.element_at(each, (F.col("doc_id") % 9 + 1).cast("int")).alias("path"))


@query(f"WITH {_PATHS} SELECT doc_id, path, doc_id % 9 IN (0, 7) OR doc_id % 9 = 4 AS included, doc_id % 9 = 2 AS in_skipped_directory FROM p")
def included_paths(s, d):
    keep = scan.include_filter(F.col("path"), ["*.py", "*.js"], scan.IGNORED)
    return _paths(s, d).select("doc_id", "path", keep.alias("included"), scan.in_skipped_directory(F.col("path")).alias("in_skipped_directory"))


@query("SELECT doc_id, source AS project_name FROM documents WHERE source = 'src1'")
def one_project(s, d):
    rows = adapt.raw_files(s, d)
    return search.filtered(rows, project="src1").select("doc_id", "project_name")


@query("SELECT source AS project_name, count(*) > 0 AS indexed FROM documents GROUP BY source")
def projects_indexed(s, d):
    return stats.indexed_projects(adapt.raw_files(s, d))


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def page_of_documents(s, d):
    return search.page(adapt.table(s, d, "documents").select("doc_id", "text"), ["doc_id"], 100, 50)


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents ORDER BY doc_id LIMIT 10")
def text_preview(s, d):
    rows = adapt.table(s, d, "documents").select("doc_id", F.col("text").alias("content"))
    return search.previewed(rows.orderBy("doc_id"), 10).select("doc_id", "preview")


@query("SELECT doc_id, '{\"lang\":\"' || lang || '\",\"n_chars\":\"' || n_chars || '\",\"source\":\"' || source || '\"}' AS metadata FROM documents")
def derived_metadata(s, d):
    rows = adapt.table(s, d, "documents").select("doc_id", "lang", "n_chars", "source")
    return rows.select("doc_id", F.to_json(search.metadata_of(rows, ["doc_id"])).alias("metadata"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'kept' ELSE 'new' END AS side, count(*) AS n, count(a) AS with_a, count(b) AS with_b FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS b FROM orders) GROUP BY 1")
def upsert_unequal_columns(s, d):
    o = adapt.table(s, d, "orders")
    table = o.select("o_orderkey", F.col("o_totalprice").alias("a"))
    fresh = o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_custkey").alias("b"))
    got = changes.upsert(table, fresh, ["o_orderkey"])
    return got.groupBy(F.when(F.col("o_orderkey") % 2 == 0, "kept").otherwise("new").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("with_a"), F.count("b").alias("with_b"))


@query("SELECT vec_id AS node_id, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE 'old' END AS version, len(embedding) AS dims FROM embeddings WHERE vec_id % 10 <> 4 OR vec_id % 4 <> 0 UNION ALL SELECT vec_id, 'old', len(embedding) FROM embeddings WHERE vec_id % 10 = 4 AND vec_id % 4 = 0")
def upsert_vectors(s, d):
    e = adapt.table(s, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    old = e.withColumn("version", F.lit("old"))
    cut = F.when(F.col("node_id") % 10 == 4, F.slice("vector", 1, 3)).otherwise(F.col("vector"))
    new = e.filter("node_id % 4 = 0").withColumn("vector", cut).withColumn("version", F.lit("new"))
    return changes.upsert_vectors(old, new, 64).select("node_id", "version", F.size("vector").cast("long").alias("dims"))


# ---- vectors and embeddings


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))), 1) AS similarity, true AS close FROM embeddings, q")
def cosine_single_precision(s, d):
    e = adapt.table(s, d, "embeddings")
    q = [float(x) for x in e.filter("vec_id = 0").select("embedding").first()[0]]
    single, double = V.cosine_float(F.col("embedding"), V.literal(q)).cast("double"), V.cosine(F.col("embedding"), V.literal(q))
    return e.select("vec_id", F.round(single, 1).alias("similarity"), (F.abs(single - double) < 1e-5).alias("close"))


@query("SELECT vec_id, len(embedding) AS dims, CAST(CAST(embedding[1] AS FLOAT) AS DOUBLE) AS first FROM embeddings")
def checked_float_vectors(s, d):
    e = adapt.table(s, d, "embeddings").select("vec_id", V.as_floats(V.checked(F.col("embedding"), 64)).alias("v"))
    return e.select("vec_id", F.size("v").cast("long").alias("dims"), F.col("v")[0].cast("double").alias("first"))


@query("SELECT doc_id, CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE round(sqrt(list_sum(list_transform(range(0, 16), lambda i: pow(CAST(('0x' || substr(md5(text), 31 - 2 * CAST(i AS INTEGER), 2)) AS INTEGER) / 255.0, 2)))), 3) END AS norm, 16 AS dims FROM documents")
def embed_documents(s, d):
    """Vectors of a provider, made in Arrow batches."""
    rows = embed(adapt.table(s, d, "documents").select("doc_id", F.col("text").alias("content")), HashProvider(16))
    return rows.select("doc_id", F.round("norm", 3).alias("norm"), F.size("embedding").alias("dims"))


@query("SELECT doc_id, least(length(text), 700) AS chars FROM documents")
def embedding_input(s, d):
    return adapt.table(s, d, "documents").select("doc_id", F.length(T.truncate_chars(F.col("text"), 200)).alias("chars"))


# ---- chunks of generated files: lines of forty characters, so that windows can be told by arithmetic

_LINES = "l AS (SELECT doc_id, (doc_id % 40) * 60 AS n FROM documents)"


def _line_files(s, d):
    n = ((F.col("doc_id") % 40) * 60).cast("int")
    return adapt.table(s, d, "documents").select("doc_id", F.array_join(F.array_repeat(F.lit("x" * 39), n), "\n").alias("content"))


@query(f"WITH {_LINES}, big AS (SELECT * FROM l WHERE n * 40 - 1 > 30000), w AS (SELECT doc_id, n, unnest(range(0, 1 + CAST(ceil((n - 500) / 450) AS BIGINT))) AS k FROM big) SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(k * 450 + 1 AS INTEGER) AS start_line, CAST(least(k * 450 + 500, n) AS INTEGER) AS end_line, (least(k * 450 + 500, n) - k * 450) * 40 - 1 AS chars FROM w UNION ALL SELECT doc_id, 0, 1, greatest(n, 1), greatest(n * 40 - 1, 0) FROM l WHERE n * 40 - 1 <= 30000")
def chunk_windows(s, d):
    got = chunking.chunk_files(_line_files(s, d), ["doc_id"])
    return got.select("doc_id", "chunk_index", "start_line", "end_line", F.length("content").cast("long").alias("chars"))


@query(f"WITH {_LINES}, big AS (SELECT * FROM l WHERE n * 40 - 1 > 30000), w AS (SELECT doc_id, unnest(range(0, CAST(ceil((n - 50) / 450) AS BIGINT) + 50)) AS k FROM big) SELECT doc_id, count(*) AS chunks, CAST(max(1 + k * 450) AS INTEGER) AS last_line FROM w GROUP BY doc_id UNION ALL SELECT doc_id, 1, 1 FROM l WHERE n * 40 - 1 <= 30000")
def chunk_windows_sliding_on(s, d):
    """With ``compat``: windows that slide to the last line."""
    got = chunking.chunk_files(_line_files(s, d), ["doc_id"], compat=True)
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("start_line").alias("last_line"))


@query("SELECT doc_id, 1 + CAST(ceil(((doc_id % 6) * 20000 + 1 - 30000) / 30000.0) AS INTEGER) AS chunks, (doc_id % 6) * 20000 + 1 AS chars FROM documents WHERE (doc_id % 6) * 20000 + 1 > 30000 UNION ALL SELECT doc_id, 1, (doc_id % 6) * 20000 + 1 FROM documents WHERE (doc_id % 6) * 20000 + 1 <= 30000")
def split_lines(s, d):
    """One long line without breaks is cut at the byte limit, and nothing is lost."""
    rows = adapt.table(s, d, "documents").select("doc_id", F.repeat(F.lit("y"), ((F.col("doc_id") % 6) * 20000 + 1).cast("int")).alias("content"))
    got = chunking.chunk_files(rows, ["doc_id"])
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH {_LINES}, big AS (SELECT * FROM l WHERE n * 40 - 1 > 10000) SELECT doc_id, 1 + CAST(ceil((n - 256) / 230.0) AS INTEGER) AS chunks FROM big UNION ALL SELECT doc_id, 1 FROM l WHERE n * 40 - 1 <= 10000")
def chunk_token_windows(s, d):
    """Chunks by tokens: 256 lines of 39 characters hold 10,000, and 26 of them are repeated in the next."""
    got = chunking.chunk_by_token_rows(_line_files(s, d), ["doc_id"])
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunks"))


# ---- batches, profiles, tuning


@query("SELECT event_id, 100 // (event_id % 7) AS result FROM events WHERE event_id % 7 <> 0")
def process_batches(s, d):
    rows = adapt.table(s, d, "events").select("event_id", (F.col("event_id") % 7).alias("v"))
    return batches.process(rows, ["event_id"], "v", lambda v: 100 // v, "long")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'ZeroDivisionError' END AS failed FROM events")
def process_batches_reported(s, d):
    rows = adapt.table(s, d, "events").select("event_id", (F.col("event_id") % 7).alias("v"))
    got = batches.process(rows, ["event_id"], "v", lambda v: 100 // v, "long", keep_failed=True)
    return got.select("event_id", F.nullif(F.substring_index(F.coalesce("error", F.lit("")), ":", 1), F.lit("")).alias("failed"))


@query("SELECT event_type, count(*) AS operations, round(avg(value), 4) AS mean_ms, count(*) FILTER (value > 100) AS slow, count(*) FILTER (value > 20) * 50 AS saved_ms, CASE WHEN avg(value) < 10 THEN 1000 WHEN avg(value) < 100 THEN 100 ELSE 10 END AS batch_size FROM events GROUP BY event_type")
def performance_report(s, d):
    e = adapt.table(s, d, "events").select("event_type", F.col("value").alias("duration_ms"), (F.col("value") > 20).alias("hit"))
    return profiling.performance_report(e, "event_type").withColumn("mean_ms", F.round("mean_ms", 4))


@query("SELECT p_partkey, CASE WHEN p_retailprice > 10000 THEN 10 WHEN p_retailprice > 1000 THEN 50 ELSE 100 END AS batch_size, CASE WHEN p_size > 40 THEN least(10000, p_partkey * 2) WHEN p_size > 10 THEN least(1000, p_partkey) END AS cache_size, CASE WHEN p_size > 40 THEN 7200 WHEN p_size > 10 THEN 3600 END AS cache_ttl_seconds FROM part")
def tuned_settings(s, d):
    rows = adapt.table(s, d, "part")
    got = profiling.tuned_columns(F.col("p_retailprice"), F.col("p_partkey"), F.col("p_size") * F.when(F.col("p_size") > 40, 100).otherwise(1))
    return rows.select("p_partkey", got["batch_size"].cast("int").alias("batch_size"), got["cache_size"].cast("long").alias("cache_size"), got["cache_ttl_seconds"].cast("int").alias("cache_ttl_seconds"))


# ---- changes over time

_EV = "ev AS (SELECT 'src/file_' || user_id || '.py' AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind, epoch_us(ts) AS t FROM events), o AS (SELECT path, kind, t, row_number() OVER (PARTITION BY path ORDER BY t, kind) AS k, count(*) OVER (PARTITION BY path) AS n FROM ev)"
_DELAY = 3_600_000_000


@query(f"""WITH RECURSIVE {_EV}, run AS (
  SELECT path, k, n, t AS last, CAST(NULL AS BIGINT) AS held_t, CAST(NULL AS VARCHAR) AS held_k, [{{'t': t, 'kind': kind, 'e': t}}] AS out FROM o WHERE k = 1
  UNION ALL
  SELECT o.path, o.k, o.n,
    CASE WHEN o.t - x.l1 >= {_DELAY} THEN o.t ELSE x.l1 END,
    CASE WHEN o.t - x.l1 >= {_DELAY} THEN NULL ELSE o.t END,
    CASE WHEN o.t - x.l1 >= {_DELAY} THEN NULL ELSE o.kind END,
    list_concat(CASE WHEN x.fire THEN [{{'t': x.held_t, 'kind': x.held_k, 'e': x.l1}}] ELSE [] END, CASE WHEN o.t - x.l1 >= {_DELAY} THEN [{{'t': o.t, 'kind': o.kind, 'e': o.t}}] ELSE [] END)
  FROM o JOIN (SELECT r.*, r.held_t IS NOT NULL AND q.t >= r.last + {_DELAY} AS fire, CASE WHEN r.held_t IS NOT NULL AND q.t >= r.last + {_DELAY} THEN r.last + {_DELAY} ELSE r.last END AS l1 FROM run r JOIN o q ON q.path = r.path AND q.k = r.k + 1) x ON o.path = x.path AND o.k = x.k + 1),
all_rows AS (SELECT path, unnest(out) AS x FROM run UNION ALL SELECT path, {{'t': held_t, 'kind': held_k, 'e': last + {_DELAY}}} FROM run WHERE k = n AND held_t IS NOT NULL)
SELECT path, x.kind AS change_type, make_timestamp(x.t) AS ts, make_timestamp(x.e) AS emitted FROM all_rows""")
def debounce_changes(s, d):
    return streaming.debounced(adapt.change_events(s, d).select("path", "change_type", "ts"), delay=3600.0)


@query("WITH e AS (SELECT 'src/file_' || user_id || '.py' AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, ts, event_id FROM events), m AS (SELECT min(ts) AS since, max(ts) AS last FROM e), p AS (SELECT count(DISTINCT path) AS pending, count(*) AS changes_today FROM e, m WHERE CAST(ts AS DATE) = CAST(last AS DATE)) SELECT since, pending AS pending_changes, changes_today, last AS last_change, (SELECT string_agg(change_type || ':' || path, ',' ORDER BY ts DESC, event_id DESC) FROM (SELECT * FROM e ORDER BY ts DESC, event_id DESC LIMIT 5)) AS recent_changes FROM m, p")
def monitoring_status(s, d):
    """Of a log of changes whose last day has not been worked off."""
    events = adapt.change_events(s, d)
    upto = events.agg(F.date_trunc("day", F.max("ts")).alias("t")).first()["t"]
    return streaming.monitoring(events, upto).select("since", "pending_changes", "changes_today", "last_change", F.array_join(F.transform("recent_changes", lambda c: F.concat_ws(":", c["change_type"], c["path"])), ",").alias("recent_changes"))


def _log(s, d):
    """The event table as a log that a stream reads."""
    rows, at = adapt.table(s, d, "events"), fresh(s, "log")
    rows.write.parquet(at)
    return s.readStream.schema(rows.schema).parquet(at)


@query("SELECT 'src/file_' || user_id || '.py' AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, ts FROM events WHERE event_type <> 'view'")
def streamed_changes(s, d):
    """The event log as a stream, filtered and taken in to its end."""
    return streaming.drained(adapt.as_changes(_log(s, d).filter("event_type <> 'view'")).select("path", "change_type", "ts"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, count(*) AS changes FROM events GROUP BY ALL")
def streamed_hours(s, d):
    """Changes by hour, counted by a stream that keeps late rows."""
    rows = adapt.as_changes(_log(s, d)).withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.drained(streaming.windowed(rows, "1 hour", "10 minutes"), mode="complete").select(F.col("window.start").cast(adapt.table(s, d, "events").schema["ts"].dataType).alias("hour"), "change_type", "changes")


@query(f"""WITH {SAMPLES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 23),
c AS (SELECT vec_id AS chunk_id, vec_id // 2 AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
hit AS (SELECT chunk_id, doc_id, list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v))) AS sim FROM c, q WHERE doc_id IN (SELECT doc_id FROM documents) ORDER BY sim DESC, chunk_id LIMIT 20)
SELECT h.chunk_id, h.doc_id, total AS total_complexity, coalesce((SELECT string_agg(name || ':' || complexity, ',' ORDER BY line_start) FROM fun f WHERE f.doc_id = h.doc_id AND complexity > 10), '') AS complex_functions FROM hit h JOIN graded g USING (doc_id) WHERE NOT broken AND total > 15""")
def find_complex_code(s, d):
    """The chunks most like a vector, of files above a total complexity, with their functions above a bound."""
    q = [float(x) for x in adapt.table(s, d, "embeddings").filter("vec_id = 23").select("embedding").first()[0]]
    src = _sources(s, d)
    chunks = adapt.table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id DIV 2").alias("doc_id"), "embedding").join(src.select("doc_id"), "doc_id")
    hits = chunks.withColumn("similarity", search.similarity(q)).orderBy(F.desc("similarity"), "chunk_id").limit(20).select("chunk_id", "doc_id", "similarity")
    few = src.join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    got = complexity.complex_hits(hits, complexity.summary(complexity.analyze_files(few, ["doc_id"]), ["doc_id"]), ["doc_id"])
    named = F.array_join(F.transform("complex_functions", lambda f: F.concat_ws(":", f["name"], f["complexity"])), ",")
    return got.select("chunk_id", "doc_id", "total_complexity", named.alias("complex_functions"))


def _share_sql(language: str) -> str:
    words = "regexp_extract_all(text, '[A-Za-z_]+')"
    return f"0.3::DOUBLE * len(list_filter({words}, lambda w: w IN ({', '.join(repr(w) for w in detection.KEYWORDS[language])}))) / greatest(len({words}), 1)"


@query(f"WITH w AS (SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [{', '.join(_share_sql(g) for g in detection.KEYWORDS)}]) AS v FROM embeddings JOIN documents ON doc_id = vec_id // 2) SELECT vec_id, len(v) AS dims, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[65] / sqrt(list_dot_product(v, v)), 6) AS python, round(v[68] / sqrt(list_dot_product(v, v)), 6) AS kotlin FROM w")
def language_enriched_embedding(s, d):
    e = adapt.table(s, d, "embeddings").withColumn("doc_id", F.expr("vec_id DIV 2")).join(adapt.table(s, d, "documents").select("doc_id", "text"), "doc_id")
    v = e.select("vec_id", detection.enriched(F.col("embedding"), F.col("text")).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("dims"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[64], 6).alias("python"), F.round(F.col("v")[67], 6).alias("kotlin"))


@query("SELECT source AS project_name, count(*) AS files, count(*) FILTER (doc_id % 3 = 0 OR doc_id % 5 = 0) AS tested, round(count(*) FILTER (doc_id % 3 = 0 OR doc_id % 5 = 0) * 100.0 / count(*), 2) AS coverage FROM documents GROUP BY source")
def test_coverage(s, d):
    n = F.col("doc_id").cast("string")
    paths = F.array_compact(F.array(F.concat(F.lit("pkg/f"), n, F.lit(".py")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("tests/test_f"), n, F.lit(".py"))), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("pkg/f"), n, F.lit("_test.py")))))
    return stats.test_coverage(adapt.table(s, d, "documents").select(F.col("source").alias("project_name"), F.explode(paths).alias("path")))
