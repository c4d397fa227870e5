"""Secret scans by multipart credential linking, in column expressions and window functions only.

Strong parts stand alone: assigned secrets, access identifiers, long hexadecimal strings. Weak parts (account names, endpoints,
unassigned random-looking strings) are candidates. Scopes are the sections of a text: a line that holds only a name in square brackets or a
rule, or two empty lines, begins the next. Within a scope, each part's interval is widened by ``REACH`` code points and joined with the
parts it meets; a weak candidate is reported only where the parts that complete it are among them: an account or endpoint needs a
secret and either of the two others, a random-looking string needs an account or access identifier and an endpoint. A weak candidate
inside another part (a random-looking piece of an endpoint, say) is no part of its own: one string never plays two roles.
The interval join is an ordered window per scope over the starts and widened ends of the few parts of documents that hold parts
of two roles; it makes no pair rows and no document's text takes part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.cluster import checkpoint
from quarry.llm.sqltext import joined, no_spans, of_kind, replaced, spans

REACH = 200
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "account", "endpoint", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ACCOUNT = r"""(?i:user(?:name)?|login|account|client_?id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
ENDPOINT = r"""(?:https?|ftp|ssh|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>,;]+"""
#: A digit, a capital and a small letter, each wherever in the string.
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}"
BREAK = r"\n[ \t]*(?:\[[^\]\n]+\]|[-=#*_]{3,})[ \t]*(?=\n|$)|\n(?:[ \t]*\n){2,}"
MARK = "[SECRET]"
_FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"


def _any(text: Column, *parts: str) -> Column:
    test = F.lit(False)
    for p in parts:
        test = test | F.contains(text, F.lit(p))
    return test


def _assigned(t: Column) -> Column:
    """Spans of assignments whose value has 12 characters or more; a shorter one is passed over, as one match."""
    value = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v))
    both = F.arrays_zip(spans(t, ASSIGN).alias("s"), value.alias("n"))
    return F.transform(F.filter(both, lambda x: x["n"] >= 12), lambda x: x["s"])


def base_parts(t: Column) -> list[Column]:
    """The spans of each base kind; cheap tests keep most texts from the patterns."""
    low = F.lower(t)
    return [
        F.when(_any(low, "passw", "secret", "token", "api"), _assigned(t)).otherwise(no_spans()),
        F.when(F.contains(t, F.lit("AKIA")), spans(t, ACCESS)).otherwise(no_spans()),
        F.when(F.rlike(t, F.lit(HEX)), spans(t, HEX)).otherwise(no_spans()),
    ]


def _weak_parts(t: Column) -> list[Column]:
    """The spans of each weak kind, and the breaks between scopes."""
    low = F.lower(t)
    who = _any(low, "user", "login", "account", "client", "access_key")
    there = F.contains(t, F.lit("://"))
    return [
        F.when(who, spans(t, ACCOUNT)).otherwise(no_spans()),
        F.when(there, spans(t, ENDPOINT)).otherwise(no_spans()),
        F.when(there & (who | F.contains(t, F.lit("AKIA"))), spans(t, RANDOM)).otherwise(no_spans()),
        F.when(F.contains(t, F.lit("\n")) & (who | there), spans(t, BREAK)).otherwise(no_spans()),
    ]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, t and a key of each row's contents: rows that repeat have one key and one result."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return rows.withColumn("key", F.struct(F.xxhash64("id", "t").alias("a"), F.hash("t", "id").alias("b"), F.length("t").alias("n")))


def _parts(rows: DataFrame) -> DataFrame:
    cols = [x.alias(k) for k, x in zip([*KINDS, "break"], [*base_parts(F.col("t")), *_weak_parts(F.col("t"))], strict=True)]
    return rows.select("id", "key", *cols)


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, linked): the weak candidates that complementary parts of their scope stand within reach of."""
    secret = F.size("assign") + F.size("hex") + F.size("random")
    who, where = F.size("access") + F.size("account"), F.size("endpoint")
    roles = (secret > 0).cast("int") + (who > 0).cast("int") + (where > 0).cast("int")
    some = parts.filter((roles >= 2) & (F.size("account") + F.size("endpoint") + F.size("random") > 0)).dropDuplicates(["key"])
    rows = some.select("key", F.explode(F.concat(*(of_kind(F.col(k), k) for k in [*KINDS, "break"]))).alias("p")).select("key", "p.*")
    in_order = Window.partitionBy("key").orderBy("start", F.col("end").desc(), "kind")
    broken = F.sum((F.col("kind") == "break").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    around = F.max(F.when(F.col("kind") != "break", F.col("end"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    inner = F.col("kind").isin("account", "endpoint", "random") & (F.col("end") <= F.coalesce("around", F.lit(-1)))
    rows = rows.select("*", broken.alias("scope"), around.alias("around")).filter((F.col("kind") != "break") & ~inner)
    # A part meets what starts by end + reach and ends from start - reach on. Each part is added at its start and asks at end + reach,
    # after what is added there: of a role, the furthest end so far tells whether one meets it.
    asks = F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("ask")), F.struct((F.col("end") + reach).alias("at"), F.lit(1).alias("ask")))
    events = rows.select("*", F.explode(asks).alias("x")).select("key", "scope", "kind", "start", "end", "x.*")
    so_far = Window.partitionBy("key", "scope").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    roles = {"secret": ["assign", "hex", "random"], "who": ["access", "account"], "where": ["endpoint"], "strong": ["assign", "hex"]}
    meets = {role: F.max(F.when((F.col("ask") == 0) & F.col("kind").isin(kinds), F.col("end"))).over(so_far) >= F.col("start") - reach for role, kinds in roles.items()}
    flagged = events.select("*", *(F.coalesce(x, F.lit(False)).alias(f"has_{k}") for k, x in meets.items())).filter("ask = 1")
    whole = (
        (F.col("kind") == "account") & F.col("has_secret") & (F.col("has_where") | F.col("has_strong"))
        | (F.col("kind") == "endpoint") & F.col("has_secret") & F.col("has_who")
        | (F.col("kind") == "random") & F.col("has_where") & F.col("has_who")
    )
    return flagged.filter(whole).groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("linked"))


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: counts of base kinds, base digest, all spans (base and linked).

    A null text is empty. Repeated rows have one result each. A null id stays null. Spans of different kinds may overlap.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    parts = checkpoint(_parts(_keyed(docs, doc_id, text)))
    out = parts.join(linked(parts, reach), "key", "left")
    base = F.concat(*(of_kind(F.col(k), k) for k in BASE))
    every = F.concat(base, F.coalesce("linked", F.array().cast(_FOUND)))
    return out.select(
        F.col("id").alias(doc_id), *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(every, KINDS).alias("spans"),
    )


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", chars: str | None = "n_chars", reach: int = REACH, mark: str = MARK) -> DataFrame:
    """The documents with every span found (base and linked) replaced by ``mark``; overlapping spans become one mark.

    Columns stay, ``chars`` (if there) follows the new length. Rows without findings, null texts too, stay as they are. Each row is judged by
    its own text: ids may be null or repeat, and rows that repeat have one result each. An empty table stays empty. Texts that a cheap test
    clears, nearly all, aren't shuffled: only the others are joined with what was found in them.
    """
    maybe = F.coalesce(_suspect(F.col(text)), F.lit(False))
    return docs.filter(~maybe).unionByName(_redacted(docs.filter(maybe), doc_id, text, chars, reach, mark))


def _suspect(t: Column) -> Column:
    """True of every text that can hold a base span. Weak parts alone are never reported; they need a secret or an identifier, or
    an account and an endpoint around a random-looking string."""
    low = F.lower(t)
    return _any(low, "passw", "secret", "token", "api") | F.contains(t, F.lit("AKIA")) | F.contains(t, F.lit("://")) | F.rlike(t, F.lit(HEX))


def _redacted(docs: DataFrame, doc_id: str, text: str, chars: str | None, reach: int, mark: str) -> DataFrame:
    if chars in docs.columns:
        names = docs.columns
    else:
        names, chars = docs.columns, None
    key = F.struct(F.xxhash64(doc_id, F.coalesce(text, F.lit(""))).alias("a"), F.hash(F.coalesce(text, F.lit("")), doc_id).alias("b"), F.length(F.coalesce(text, F.lit(""))).alias("n"))
    parts = checkpoint(_parts(_keyed(docs, doc_id, text)).filter(F.size(F.concat(*(F.col(k) for k in KINDS))) > 0).drop("id").dropDuplicates(["key"]))
    found = parts.join(linked(parts, reach), "key", "left")
    every = F.concat(*(of_kind(F.col(k), k) for k in BASE), F.coalesce("linked", F.array().cast(_FOUND)))
    found = found.select(F.col("key").alias("__key"), F.transform(every, lambda x: F.struct(x["start"], x["end"])).alias("__spans")).filter(F.size("__spans") > 0)
    joined_rows = docs.withColumn("__k", key).join(found, F.col("__k") == F.col("__key"), "left")
    done_rows = joined_rows.withColumn("__new", F.when(F.col("__spans").isNull(), F.col(text)).otherwise(replaced(F.col(text), F.col("__spans"), mark)))
    kept = F.col("__spans").isNull()
    put = {text: F.col("__new")} | ({chars: F.when(kept, F.col(chars)).otherwise(F.length("__new")).cast(docs.schema[chars].dataType)} if chars else {})
    return done_rows.select(*(put.get(c, F.col(c)).alias(c) for c in names))
