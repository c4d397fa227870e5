"""Language detection: by extension, by syntax, by a lexer's guess and by votes of lines, and the cascade of the first three.

Equal (content, path) pairs are detected once per task batch. Syntax checks stand in for full grammars of three languages: Python's own
parser, and bracket and keyword evidence for JavaScript and Java.
"""

from __future__ import annotations

import ast
import functools
import re
import warnings
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.parallel import spread
from quarry.functions.text import suffix
from quarry.functions.vectors import normalize
from quarry.operators.caching import Cache, key_of

#: Languages by extension, and names that lexers and users give them.
EXTENSIONS = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".rb": "ruby", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c",
    ".cs": "csharp", ".php": "php", ".swift": "swift", ".m": "objc", ".mm": "objc", ".scala": "scala", ".r": "r", ".sql": "sql", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json", ".xml": "xml", ".html": "html",
    ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".md": "markdown", ".rst": "restructuredtext", ".txt": "text",
}
NAMES = {
    "python": "python", "python3": "python", "py": "python", "javascript": "javascript", "js": "javascript", "node": "javascript", "typescript": "typescript", "ts": "typescript", "java": "java", "kotlin": "kotlin", "kt": "kotlin", "c++": "cpp", "cpp": "cpp", "c": "c", "c#": "csharp",
    "csharp": "csharp", "cs": "csharp", "objective-c": "objc", "objc": "objc", "objectivec": "objc", "scdoc": "python", "numpy": "python", "text only": "text", "text": "text", "tera term macro": "kotlin",
}
#: Substrings of which any raises the confidence in a language.
BOOSTS = {
    "python": [(("import ", "from "), 0.05), (("def ", "class "), 0.05), (("__init__", "__name__"), 0.1)],
    "javascript": [(("function ", "const ", "let "), 0.05), (("console.log", "require("), 0.05), (("=>", "async "), 0.05)],
    "java": [(("public class", "private "), 0.05), (("System.out", "import java"), 0.1), (("@Override", "extends "), 0.05)],
}
VOTES = {
    "python": r"^\s*(?:def |class |import |from \S+ import |elif |print\()", "javascript": r"^\s*(?:function |const |let |var |export |import .* from )|=>|console\.log",
    "java": r"^\s*(?:public |private |protected |package |import java|@Override)", "kotlin": r"^\s*(?:fun |val |var |data class |sealed |object )",
    "go": r"^\s*(?:func |package |import \(|type \w+ struct)", "rust": r"^\s*(?:fn |let mut |impl |pub |use \w+::)", "sql": r"(?i)^\s*(?:select |insert into |create table |update \w+ set )", "shell": r"^\s*(?:#!/bin|fi$|done$|echo |export )",
}
KEYWORDS = {"python": ["def", "class", "import", "self", "lambda"], "java": ["public", "class", "void", "static", "extends"], "javascript": ["function", "const", "let", "var", "async"], "kotlin": ["fun", "val", "var", "data", "when"]}
RESULT = "struct<language:string,confidence:double,method:string>"
NONE = ("unknown", 0.0)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def by_extension(path: Column) -> Column:
    known = F.element_at(_map(EXTENSIONS), suffix(path))
    return F.struct(F.coalesce(known, F.lit("unknown")).alias("language"), F.when(known.isNotNull(), 0.7).otherwise(0.0).alias("confidence"), F.lit("extension").alias("method"))


def normalized(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.coalesce(F.element_at(_map(NAMES), low), low)


def boost(content: Column, language: str) -> Column:
    total = F.lit(0.0)
    for parts, gain in BOOSTS.get(language, []):
        total = total + F.when(reduce(lambda a, b: a | b, (F.contains(content, F.lit(p)) for p in parts)), gain).otherwise(0.0)
    return total


def adjusted(content: Column, language: str, base: Column) -> Column:
    return F.least(F.lit(1.0), base + boost(content, language))


def by_votes(content: Column, lines: int = 50) -> Column:
    """The language whose pattern most of the first lines match, and a confidence that grows with their number."""
    head = F.slice(F.split(content, "\n"), 1, lines)
    hits = lambda p: F.size(F.filter(head, lambda x: F.rlike(x, F.lit(p))))
    counts = F.array(*(F.struct(hits(p).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("language")) for k, (name, p) in enumerate(VOTES.items())))
    best = F.array_max(counts)
    confidence = F.when(best["n"] == 0, 0.0).otherwise(F.least(0.6 + best["n"] / 50, F.lit(0.85)))
    return F.struct(F.when(best["n"] == 0, "unknown").otherwise(best["language"]).alias("language"), confidence.alias("confidence"), F.lit("votes").alias("method"))


def keyword_share(content: Column, language: str) -> Column:
    """Of the runs of letters and underscores, the share that are keywords; counted in place, without a list of words."""
    keywords = rf"(?<![A-Za-z_])(?:{'|'.join(KEYWORDS[language])})(?![A-Za-z_])"
    words = F.regexp_count(content, F.lit("[A-Za-z_]+"))
    return F.when(words == 0, 0.0).otherwise(F.regexp_count(content, F.lit(keywords)) / words)


def enriched(embedding: Column, content: Column, weight: float = 0.3) -> Column:
    """A vector with the shares of each language's keywords behind it, of length 1."""
    shares = F.array(*(keyword_share(content, g) * weight for g in KEYWORDS))
    return normalize(F.concat(F.transform(embedding, lambda x: x.cast("double")), shares))


_PY_SYNTAX = re.compile(r"^\s*(?:def|class|import|from|if|for|while|with|try|return|async)\b|[=()\[\]]", re.MULTILINE)
_JS = re.compile(r"\b(?:function|const|let|var|typeof|undefined|console|require|export|async|await)\b|=>|===")
_JAVA = re.compile(r"\b(?:public|private|protected|package|implements|extends|void|throws|final|static)\b|@Override|System\.out")


def _python(text: str) -> float:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_in_parts(text)
    return 0.95 if tree.body and _PY_SYNTAX.search(text) else 0.0


_TOP = re.compile(r"^(?=\S)(?!(?:else|elif|except|finally)\b)", re.MULTILINE)
_PY_WORDS = re.compile(r"^\s*(?:def|class|import|from|async def|@\w)\b", re.MULTILINE)


def _python_in_parts(text: str) -> float:
    """Of a source that doesn't parse, the share of its statements at the margin that do; two of them must look like Python."""
    if len(_PY_WORDS.findall(text)) < 2:
        return 0.0
    parts = [p for p in _TOP.split(text) if p.strip()]
    good = 0
    for p in parts:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                good += bool(ast.parse(p).body)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return good / len(parts) * 0.95 if parts else 0.0


def _braced(evidence: re.Pattern, other: re.Pattern):
    def test(text: str) -> float:
        n, m = len(evidence.findall(text)), len(other.findall(text))
        if not n or m >= n:
            return 0.0
        brackets, apart = sum(map(text.count, "{}()[]")), sum(abs(text.count(a) - text.count(b)) for a, b in ("{}", "()", "[]"))
        if apart:  # the share of brackets that have a partner, where enough else speaks for the language
            return 0.95 * (1 - apart / brackets) if n >= 4 and n > 2 * m else 0.0
        return 0.95 if ("{" in text or ";" in text or "=>" in text) and n >= 2 else 0.6

    return test


#: Replaceable by language: text -> confidence without boosts.
SYNTAX: dict[str, Callable[[str], float]] = {"python": _python, "javascript": _braced(_JS, _JAVA), "java": _braced(_JAVA, _JS)}


def add_parser(language: str, test: Callable[[str], float]) -> None:
    SYNTAX[language] = test


def remove_parser(language: str) -> bool:
    return SYNTAX.pop(language, None) is not None


def by_syntax(text: str | None, checks: dict[str, Callable[[str], float]] | None = None) -> tuple[str, float]:
    """Boosts apply above 0.5; the first of equal confidences stays."""
    best = NONE
    if text and text.strip():
        for name, test in (SYNTAX if checks is None else checks).items():
            c = test(text)
            if c > 0.5:
                c = min(1.0, c + sum(gain for parts, gain in BOOSTS.get(name, []) if any(p in text for p in parts)))
            if c > best[1]:
                best = (name, c)
    return best


@functools.cache
def _lexers() -> list:
    """The lexers that look at a text to tell whether it is theirs, in the library's order."""
    from pygments.lexer import Lexer
    from pygments.lexers import LEXERS, find_lexer_class

    every = [find_lexer_class(row[1]) for row in LEXERS.values()]
    return [c for c in every if any("analyse_text" in k.__dict__ for k in c.__mro__ if k not in (Lexer, object))]


def _guessed(text: str) -> str | None:
    """The name of the lexer that is surest of the text; a mode line in the text rules. The list of lexers is made once a worker."""
    from pygments import lexers, modeline, util

    if mode := modeline.get_filetype_from_buffer(text):
        try:
            return lexers.get_lexer_by_name(mode).name
        except util.ClassNotFound:
            pass
    best, name = 0.0, None
    for c in _lexers():
        sure = c.analyse_text(text)
        if sure > best:
            best, name = sure, c.name
        if sure == 1.0:
            break
    return name


def by_lexer(text: str | None) -> tuple[str, float]:
    if not text or not text.strip():
        return NONE
    try:
        name = _guessed(text)
    except Exception:  # without the library, or where a lexer's analysis fails
        return NONE
    if not name:
        return NONE
    name = name.lower().strip()
    scale = 0.8 if len(text) < 50 else 1.1 if len(text) > 500 else 1.0
    return NAMES.get(name, name), min(0.95, 0.8 * scale)


def parsers() -> list[str]:
    return [*SYNTAX]


def detect(text: str | None, path: str | None = None, checks: dict[str, Callable[[str], float]] | None = None) -> tuple[str, float, str]:
    """Syntax at 0.9 wins, then a lexer's guess at 0.85; otherwise the most confident, an extension overruling what is below 0.5."""
    s = (*by_syntax(text, checks), "syntax")
    if s[1] >= 0.9:
        return s
    g = (*by_lexer(text), "lexer")
    if g[1] >= 0.85:
        return g
    tried = [s, g]
    name = (path or "").rsplit("/", 1)[-1]
    if "." in name[1:]:
        ext = EXTENSIONS.get("." + name.rsplit(".", 1)[1].lower())
        tried.append((ext or "unknown", 0.7 if ext else 0.0, "extension"))
    best = max(tried, key=lambda r: r[1])
    return tried[2] if best[1] < 0.5 and len(tried) > 2 and tried[2][1] > 0 else best


#: What a worker has detected lately.
SEEN = Cache(most=10_000, seconds=3600)


def remembered(text: str | None, path: str | None, checks: dict[str, Callable[[str], float]]) -> tuple[str, float, str]:
    """``detect``, once for each content. Of a path only the extension counts, so copies share an entry wherever they are."""
    name = (path or "").rsplit("/", 1)[-1]
    at = (key_of(text or "", name.rsplit(".", 1)[1].lower() if "." in name[1:] else None), *checks.values())
    found = SEEN.get(at)
    if found is None:
        found = detect(text, path, checks)
        SEEN.put(at, found)
    return found


def detect_files(files: DataFrame, key: list[str], content: str = "content", path: str = "path") -> DataFrame:
    """Key, language, confidence, method."""
    checks = dict(SYNTAX)  # those added on the driver go to the executors with the task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2
            out = [remembered(text, path, checks) for text, path in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.string())], names=[*batch.schema.names[:n], "language", "confidence", "method"])

    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in key)
    return spread(files.select(*key, F.col(content).alias("_c"), F.col(path).alias("_p"))).mapInArrow(run, f"{kinds}, language string, confidence double, method string")
