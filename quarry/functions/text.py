"""Native column expressions on paths and contents: language, category, namespace, lines, hashes, escaping, sanitising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension, and the substrings that mark kinds of files.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml", ".html": "html", ".css": "css", ".scss": "css", ".sql": "sql", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".dockerfile": "dockerfile", ".dockerignore": "dockerfile",
}
TEST_PARTS = ["test_", "_test.", "spec.", ".test.", ".spec.", "tests/", "test/", "__tests__/"]
CONFIG_PARTS = ["config", "settings", ".yaml", ".yml", ".toml", ".ini", ".env", ".json"]
CONFIG_NAMES = ["package.json", "pyproject.toml", "tsconfig.json", "webpack.config", "jest.config"]
RESOURCE_ENDS = [".sql", ".xml", ".csv", ".txt", ".dat", ".png", ".jpg", ".svg", ".css", ".scss"]
DOC_PARTS = [".md", ".rst", ".adoc", "readme", "changelog", "license", "contributing"]
#: Characters that a query must escape, in the order of the sequential mode.
SPECIALS = ["+", "-", "!", "(", ")", "{", "}", "[", "]", "^", '"', "~", "*", "?", ":", "\\", "/"]

LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
#: White space as Python's str.split has it; Java's \s is narrower.
SPACE = "[\\s\u001c-\u001f\u0085   -     　]+"
TERM_BYTES, CHUNK_BYTES = 32_000, 30_000


def _any(parts: list[str], test) -> Column:
    return reduce(lambda a, b: a | b, (test(p) for p in parts))


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last extension, lower-cased; a leading dot starts a name, not an extension, and a trailing one ends it."""
    name = filename(path)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), suffix(path)), F.lit("text"))


def file_flags(path: Column) -> dict[str, Column]:
    """is_test, is_config, is_resource, is_documentation."""
    name, full = F.lower(filename(path)), F.lower(path)
    has = lambda c: lambda p: F.contains(c, F.lit(p))
    rc = F.startswith(name, F.lit(".")) & F.endswith(name, F.lit("rc"))
    return {
        "is_test": _any(TEST_PARTS, has(full)) | _any(TEST_PARTS, has(name)),
        "is_config": _any(CONFIG_PARTS + CONFIG_NAMES, has(name)) | rc,
        "is_resource": _any(RESOURCE_ENDS, lambda p: F.endswith(name, F.lit(p))),
        "is_documentation": _any(DOC_PARTS, has(name)),
    }


def file_category(flags: dict[str, Column]) -> Column:
    out = F.when(flags["is_test"], "test").when(flags["is_config"], "config").when(flags["is_resource"], "resource")
    return out.when(flags["is_documentation"], "documentation").otherwise("source")


def namespace(path: Column, content: Column, lang: Column) -> Column:
    """Package or module path; null where there is none or the language has none."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "src").cast("int")
    inner = F.slice(parts, at + 1, F.greatest(F.size(parts) - at - 1, F.lit(0)))
    python = F.filter(inner, lambda p: ~F.startswith(p, F.lit("__")))
    site = F.regexp_extract(path, r"site-packages/([^/]*)", 1)
    some = lambda a, sep: F.when(F.size(a) > 0, F.array_join(a, sep))
    found = lambda p: F.nullif(F.regexp_extract(content, p, 1), F.lit(""))
    by_path = F.when(at > 0, some(python, ".")).when(F.contains(path, F.lit("site-packages/")), site)
    out = F.when(lang == "python", by_path).when(lang == "java", found(r"(?m)^\s*package\s+([a-zA-Z0-9_.]+)\s*;"))
    out = out.when(lang == "csharp", found(r"(?m)^\s*namespace\s+([a-zA-Z0-9_.]+)"))
    return out.when(lang.isin("typescript", "javascript"), F.when(at > 0, some(inner, "/")))


def fold_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def line_count(text: Column) -> Column:
    """Lines as Python's splitlines counts them; none in an empty or null text."""
    n = F.regexp_count(text, F.lit(LINE_END)) + F.when(F.rlike(text, F.lit(f"(?:{LINE_END})\\z")), 0).otherwise(1)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(n).cast("int")


def phrase_quote(query: Column) -> Column:
    """The query as a quoted phrase; an empty one stays."""
    inner = F.replace(F.replace(query, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(query == "", query).otherwise(F.concat(F.lit('"'), inner, F.lit('"')))


def escape_query(query: Column, sequential: bool = False) -> Column:
    """Specials behind two backslashes, and ``&&``, ``||`` and ``->`` as wholes. Sequential mode replaces one after the other, so
    backslashes put in early are escaped again by the sixteenth step."""
    if not sequential:
        chars = "".join("\\" + c for c in SPECIALS)
        return F.regexp_replace(query, f"(&&|\\|\\||[{chars}])", "\\\\\\\\$1")
    out = F.replace(F.replace(query, F.lit("&&"), F.lit("\\&&")), F.lit("||"), F.lit("\\||"))
    for c in SPECIALS:
        out = F.replace(out, F.lit(c), F.lit("\\\\" + c))
    return F.replace(out, F.lit("->"), F.lit("\\\\->"))


def truncate_bytes(term: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes, by halving; short terms cost one test."""
    start = F.struct(F.lit(0).alias("low"), F.length(term).alias("high"))

    def half(acc: Column, _: Column) -> Column:
        mid = ((acc["low"] + acc["high"] + 1) / 2).cast("int")
        ok = F.octet_length(F.substring(term, F.lit(1), mid)) <= most
        return F.struct(F.when(ok, mid).otherwise(acc["low"]).alias("low"), F.when(ok, acc["high"]).otherwise(mid - 1).alias("high"))

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, half, lambda acc: F.substring(term, F.lit(1), acc["low"]))
    return F.when(F.octet_length(term) <= most, term).otherwise(fit)


def sanitize(text: Column, most: int = TERM_BYTES) -> Column:
    """Words one space apart, each cut to ``most`` bytes. Only a text of more bytes can hold a longer word; others need no list of words."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.when(F.octet_length(text) > most, F.array_join(F.transform(words, lambda w: truncate_bytes(w, most)), " ")).otherwise(F.trim(F.regexp_replace(text, SPACE, " ")))


def tokens(text: Column) -> Column:
    """The phrase index's words: lower-cased runs of letters, digits and underscores, no stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def project_name(raw: Column) -> Column:
    """A name fit for a project: other characters become underscores, cut to 100."""
    return F.substring(F.regexp_replace(F.trim(raw), "[^a-zA-Z0-9_-]", "_"), 1, 100)


def valid_project_name(raw: Column) -> Column:
    return F.rlike(F.trim(raw), F.lit(r"\A[a-zA-Z0-9_-]{1,100}\z"))


def full_match(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(rf"\A(?:{pattern})\z"))


def truncate_chars(text: Column, max_tokens: int = 32_000) -> Column:
    """Cut to 3.5 characters a token, as providers without a local tokenizer do."""
    return F.substring(text, 1, int(max_tokens * 3.5))


def preview(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
