"""License scans by ordered signature rules, in column expressions only.

A text is reduced to its lower-cased words, one space apart. The rules (``signatures``) are regular expressions on the words, written by
hand for names, identifiers, references and passages of licences; each is tried only where its keyword occurs, and has a priority (its
place in the list) and a weight. Of the detections, one that lies inside another is suppressed; of equal ones, the first rule's stays.
Detections are resolved in one ordered pass per document, in that document's row: nothing is shuffled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import signatures
from quarry.llm.sqltext import let, lower_ascii, spans

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels, fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words or parts of them of which every match holds one, but for those that an ordinary preposition and a short identifier make up.
GATE = ["licen", "gpl", "copyright", " cc ", "cc0", "creative commons", "public domain", "proprietary", "rights reserved", "permi", "redistribut", "warrant", " clause ", "apache", "advertising materials"]
VERSION = " [0-9] [0-9]+ "
BEFORE = [" under ", "subject to ", "governed by ", "in accordance with "]
SHORT_IDS = ["mit", "expat", "isc", "0bsd", "bsd", "artistic", "zlib", "psf", "ruby", "postgresql", "wtfpl"]


@functools.cache
def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, weight) of the signatures. Every match, with the space on each side, contains the keyword."""
    return [(label, keyword if keyword in signatures.PARTS else f" {keyword} ", f"(?<= )(?:{p})(?= )", k, w) for k, (label, keyword, w, p) in enumerate(signatures.table())]


def phrase_places(words: Column, n_words: Column, phrase: str) -> Column:
    """struct(n, first, last): how often a phrase's words stand in the spaced text, and the first and last of their word numbers."""
    cut = F.split(words, f" (?={phrase} )", -1)
    spaces = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")
    n = (F.size(cut) - 1).cast("long")
    none = F.lit(None).cast("long")
    found = F.struct(n.alias("n"), spaces(F.element_at(cut, 1)).alias("first"), (n_words - spaces(F.element_at(cut, -1))).alias("last"))
    return F.when(F.contains(words, F.lit(f" {phrase} ")), found).otherwise(F.struct(F.lit(0).cast("long").alias("n"), none.alias("first"), none.alias("last")))


def detections(words: Column) -> Column:
    """array of struct(start, minus_end, priority, label, weight) by place, longest first, then priority.

    Each signature is an expression of its own, compiled once, tried where its keyword stands; positions are found for those that match.
    """
    by_keyword: dict[str, list[Column]] = {}
    label, pattern, weight = [], [], []
    for name, keyword, p, k, w in rules():
        by_keyword.setdefault(keyword, []).append((p, k))
        label.append(F.lit(name))
        pattern.append(F.lit(p))
        weight.append(F.lit(w))
    none = F.array().cast("array<int>")
    tried = lambda text: F.flatten(F.array(*(F.when(F.contains(text, F.lit(keyword)), F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(p)), F.lit(k)) for p, k in few)))).otherwise(none) for keyword, few in by_keyword.items())))
    of = lambda values, k: F.element_at(F.array(*values), k + 1)
    placed = lambda text, k: F.transform(spans(text, of(pattern, k)), lambda s: F.struct(s["start"], (-s["end"]).alias("minus_end"), k.alias("priority"), of(label, k).alias("label"), of(weight, k).alias("weight")))
    return let(words, lambda text: F.array_sort(F.flatten(F.transform(tried(text), lambda k: placed(text, k)))))


def resolved(found: Column) -> Column:
    """struct(labels, weight): distinct labels left after containment suppression, and their largest weight.

    In the order given, a detection lies inside an earlier one exactly if it ends no later than the furthest end so far.
    """
    start = F.struct(F.lit(-1).cast("long").alias("upto"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))

    def step(acc: Column, x: Column) -> Column:
        new = -x["minus_end"] > acc["upto"]
        return F.struct(
            F.greatest(acc["upto"], -x["minus_end"]).alias("upto"),
            F.when(new, F.array_union(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(new, F.greatest(acc["weight"], x["weight"])).otherwise(acc["weight"]).alias("weight"),
        )

    return F.aggregate(found, start, step, lambda acc: F.struct(acc["labels"], acc["weight"]))


def gate(words: Column) -> Column:
    """True of every spaced text that a rule matches."""
    any_of = lambda parts: functools.reduce(lambda a, b: a | b, (F.contains(words, F.lit(p)) for p in parts))
    return any_of(GATE) | F.rlike(words, F.lit(VERSION)) | any_of(BEFORE) & any_of(f" {x} " for x in SHORT_IDS)


def find_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty: no words, no labels, score 0. Repeated rows have one result each; a null id stays null. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("id"), lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("t"))
    rows = rows.select("id", F.concat(F.lit(" "), F.trim(F.regexp_replace("t", GAP, " ")), F.lit(" ")).alias("w"))
    n_words = F.when(F.col("w") == "  ", F.lit(0)).otherwise(F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) - 1).cast("long")
    rows = rows.select("id", "w", n_words.alias("n_words"), gate(F.col("w")).alias("gate"))
    places = [phrase_places(F.col("w"), F.col("n_words"), p).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    empty = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))
    rows = rows.select("id", "n_words", *places, F.when(F.col("gate"), resolved(detections(F.col("w")))).otherwise(empty).alias("m"))
    base = F.array_compact(F.array(*(F.when(F.col(f"p{k}.n") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))))
    n_base = sum((F.col(f"p{k}.n") for k in range(1, len(PHRASES))), F.col("p0.n"))
    score = F.greatest(F.col("m.weight"), F.when(n_base > 0, F.lit(0.6)).otherwise(F.lit(0.0)))
    every = F.array_union(base, F.col("m.labels"))
    return rows.select(
        F.col("id").alias(doc_id), "n_words", n_base.alias("n_base"), F.least(*(F.col(f"p{k}.first") for k in range(len(PHRASES)))).alias("first_word"), F.greatest(*(F.col(f"p{k}.last") for k in range(len(PHRASES)))).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"), score.alias("score"),
    )
