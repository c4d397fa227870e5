"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, pairs verified on full n-gram sets.

1. Each text becomes its set of n-gram hashes, a 128-bit digest of that set, and ``bands`` band hashes of ``rows`` MinHash
   values each. There are as few bands as reach ``recall`` for a pair right at the threshold.
2. Texts with equal sets form a class, stood for by one row, so copies are counted and never paired.
3. Class representatives are shuffled on band hashes; only those in a bucket with another go on. Each bucket adds one edge per member to
   its smallest member. The components of these edges are the candidate groups: a pair that shares a band is in one group.
4. Groups are dealt over bundles of bounded size (documents and n-grams), and only their texts are shuffled. A bundle, or a pair of bundles
   where one group takes several, is verified in one task on full sets: all intersections are counted at once, by posting lists for rare
   n-grams and a matrix product for frequent ones. Only link counts and spanning edges leave the task, at most one row
   per document, so a group's pairs are never rows.

What would be one task's by its key (a bucket, group, label or set of n-grams that a large part of all rows share) is salted
(``cluster.lookup``). Comparing n different texts that are all alike costs n * n / 2 additions inside such tasks, as any exact count of
their links does; rows shuffled grow with (bundles of the group) times its texts. Texts that are alike only by a chain of chance
meetings fall into one group too: at a corpus of billions such chains, not copies, are what more rows a band would keep short.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernel
from quarry.llm.cluster import HOT_KEYS, HOT_ROWS, checkpoint, components, let_through, lookup, prefix, with_least_ids

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
BUNDLE_DOCS, BUNDLE_GRAMS = 1024, 1 << 20
#: A character of a word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: N-grams in more texts of a bundle than this are multiplied as a dense matrix.
DENSE = 24


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands of so many rows by which a pair right at the threshold shares a band with probability recall at least."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall must lie between 0 and 1")
    if threshold == 1:
        return 1, rows
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))), rows


def seeds(count: int) -> np.ndarray:
    return kernel.mix(np.arange(1, count + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def signatures(grams: np.ndarray, offs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands, int64); texts without n-grams have zeros."""
    out = np.zeros((len(offs) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if not len(full):
        return out.view(np.int64)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    y = grams.astype(np.uint32)
    starts = offs[:-1][full]
    for k, seed in enumerate(seeds(bands * rows)):
        low = np.minimum.reduceat((x ^ (y * seed)) * seed, starts)
        out[full, k // rows] = kernel.mix(out[full, k // rows] * np.uint64(0x100000001B3) + low.astype(np.uint64) + np.uint64(k + 1))
    return out.view(np.int64)


def gram_sets(arr: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct n-gram hashes, and their offsets."""
    g, offs = kernel.grams(*kernel.words(arr), n)
    row = kernel.rows_of(offs)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(offs)))


def _digest(g: np.ndarray) -> bytes:
    return hashlib.blake2b(g.tobytes(), digest_size=16).digest()


def _sign(n: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(1)):
                g, offs = gram_sets(texts, n)
                size = np.diff(offs)
                digests = [_digest(g[a:b]) if b > a else None for a, b in zip(offs[:-1], offs[1:], strict=True)]
                flat = pa.array(signatures(g, offs, bands, rows).ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), lists], names=["id", "key", "n_grams", "digest", "bands"])

    return sign


def _load(n: int):
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(k) for k in range(2, batch.num_columns)]
            wanted = batch.column(batch.schema.get_field_index("digest")).to_pylist()
            for at, texts in kernel.pieces(batch.column(1)):
                g, offs = gram_sets(texts, n)
                sets = [g[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
                # One row for each digest goes on, and only the text that has it: ids may repeat.
                ok = pa.array([hashlib.blake2b(s, digest_size=16).digest() == w for s, w in zip(sets, wanted[at : at + len(sets)], strict=True)])
                cols = [batch.column(0).slice(at, len(sets)), pa.array(sets, pa.binary()), *(c.slice(at, len(sets)) for c in rest)]
                yield pa.RecordBatch.from_arrays([c.filter(ok) for c in cols], names=["node", "grams", *batch.schema.names[2:]])

    return load


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    g, row = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(g, kind="stable")
    g, row = g[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    df = np.diff(np.append(first, len(g)))
    out = np.zeros(m * m, np.int64)
    for d in range(2, DENSE + 1):  # posting lists of d texts: all their pairs at once
        lists = first[df == d]
        for a in range(0, len(lists), 1 << 14):
            post = row[lists[a : a + (1 << 14), None] + np.arange(d)]
            i, j = np.triu_indices(d, 1)
            out += np.bincount((post[:, i] * m + post[:, j]).ravel(), minlength=m * m) if len(post) * len(i) > m * m // 4 else 0
            if len(post) * len(i) <= m * m // 4:
                np.add.at(out, (post[:, i] * m + post[:, j]).ravel(), 1)
    out = out.reshape(m, m)
    out += out.T
    wide = np.flatnonzero(df > DENSE)
    for a in range(0, len(wide), 2048):
        part = wide[a : a + 2048]
        x = np.zeros((m, len(part)), np.float32)
        for c, k in enumerate(part):
            x[row[first[k] : first[k] + df[k]], c] = 1
        out += (x @ x.T).astype(np.int64)
    np.fill_diagonal(out, 0)
    return out


def _verify(threshold: float):
    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        """One tile. Where it holds two bundles of a group, only links between them count; links inside are the own tile's."""
        column = {c: rows.column(c).combine_chunks() for c in ("node", "grp", "bundle", "n_copies", "digest", "grams")}
        node, group, bundle, copies = (column[c].to_numpy() for c in ("node", "grp", "bundle", "n_copies"))
        # A class may be loaded by several rows that share its id and text.
        first = {d: k for k, d in reversed([*enumerate(column["digest"].to_pylist())])}
        at = np.array(sorted(first.values()))
        at = at[np.lexsort((node[at], group[at]))]
        node, group, bundle, copies = node[at], group[at], bundle[at], copies[at]
        sets = [np.frombuffer(column["grams"][k].as_buffer(), np.uint64) for k in at.tolist()]
        both = intersections(sets)
        size = np.array([len(s) for s in sets])
        link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        link &= (both > 0) & (group[:, None] == group[None, :])
        if key[1].as_py() != key[2].as_py():
            link &= bundle[:, None] != bundle[None, :]
        np.fill_diagonal(link, False)
        a, b = np.nonzero(np.triu(link))
        links = link.astype(np.float64) @ copies.astype(np.float64)
        root = _spanning(len(node), a, b)
        return pa.table({"node": node, "u": node, "v": node[root], "links": links.astype(np.int64)})

    return verify


def _spanning(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked to each, directly or not."""
    label = np.arange(m)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _linked(docs: DataFrame, doc_id: str, text: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, n_grams, digest) and classes (digest, rep, first, n_links, component), all by n-gram set.

    Ids may repeat or be null, so a class has a number of its own, and components are made of numbers. first: the row that stands for
    the class, the smallest (without an id, id, key of the text); rep: its id.
    """
    bands, rows = banding(threshold, recall)
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"), _text_key(text).alias("key"))
    signed = checkpoint(source.mapInArrow(_sign(n, bands, rows), f"id {kind}, key binary, n_grams long, digest binary, bands array<long>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    classes = signed.filter("digest IS NOT NULL").groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    classes = checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    # A band's hash holds the band's number. Few buckets hold two classes; only rows that may be in one of those are shuffled again.
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    least = checkpoint(buckets.groupBy("bucket").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    shared = let_through(buckets, prefix("bucket"), least.select(prefix("bucket").alias("p"))).filter("__maybe").drop("__maybe")
    hot = least.filter(F.col("size") > HOT_ROWS).orderBy(F.desc("size")).limit(HOT_KEYS).select("bucket")
    edges = lookup(shared, least, "bucket", ["node"], hot=hot).select(F.col("node").alias("u"), "v").filter("u <> v").distinct()
    groups = components(edges).select(F.col("id").alias("node"), F.col("component").alias("grp"))
    members = checkpoint(classes.select("node", "first", "digest", "n_copies", "n_grams").join(groups, "node"))
    tiles = _tiles(members)
    # The texts of candidates alone are shuffled; of rows that repeat an id and a text, one for each task.
    texts = let_through(source, prefix("key"), members.select(prefix("first.key").alias("p"))).filter("__maybe").groupBy("id", "key").agg(F.first("t").alias("t"))
    loaded = texts.join(tiles, texts["id"].eqNullSafe(F.col("first.id")) & (texts["key"] == F.col("first.key")))
    loaded = loaded.select("node", "t", "digest", "n_copies", "grp", "bundle", "tile", "blocks")
    loaded = loaded.mapInArrow(_load(n), "node long, grams binary, digest binary, n_copies long, grp long, bundle long, tile long, blocks long")
    dealt = loaded.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node", "digest", "grams", "n_copies", "grp", "bundle", "tile", F.least("bundle", "other").alias("i"), F.greatest("bundle", "other").alias("j"))
    found = checkpoint(dealt.groupBy("tile", "i", "j").applyInArrow(_verify(threshold), "node long, u long, v long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("u <> v").select("u", "v")).select(F.col("id").alias("node"), "component")
    out = classes.select("node", "digest", "first", "n_copies").join(links, "node", "left").join(joined, "node", "left")
    out = out.select("digest", F.col("first.id").alias("rep"), "first", (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    return signed.select("id", "key", "n_grams", "digest"), out


def jaccard_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: n_grams, class_id, n_links, component_id, kept.

    class_id: the smallest id among documents with the same n-gram set. n_links: other documents with Jaccard similarity of
    at least threshold, copies included. component_id: the smallest id reachable by links. kept: doc_id = component_id.
    Words are lower-cased; a text of fewer than n words, but not none, is one n-gram. A null text, or one without words,
    links with nothing: its class and component are its own id and it is kept. Ids may be of any type that has an order. Rows that repeat
    an id are documents of their own, and links count them; they share a class if their sets are equal. component_id is of ids, as in the
    SQL: components whose classes share their smallest id have one number (``keep_one`` goes by the texts alone). A row without an id links
    and is counted as any other; where no member of a class has an id, class is null, and so is component if no row reachable has one; such
    rows are marked kept. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows, classes = _linked(docs, doc_id, text, n, threshold, recall)
    classes = checkpoint(classes.drop("first"))
    labels = with_least_ids(classes).select("digest", F.col("rep").alias("class_id"), "n_links", "component_id")
    found = lookup(rows.filter("digest IS NOT NULL"), labels, "digest", ["id", "key"]).select("id", "n_grams", "class_id", "n_links", "component_id")
    alone = rows.filter("digest IS NULL").select("id", "n_grams", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = found.unionByName(alone)
    return out.select(F.col("id").alias(doc_id), "n_grams", "class_id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _tiles(members: DataFrame) -> DataFrame:
    """Each class's tile, its bundle inside, and how many bundles its group takes.

    Groups that fit a bundle share tiles by hash; a larger group has a tile number of its own (its negated number) and is dealt over
    as many bundles as its documents and n-grams ask for.
    """
    size = members.groupBy("grp").agg(F.count(F.lit(1)).alias("d"), F.sum("n_grams").alias("g"))
    need = F.greatest(F.ceil(F.col("d") / BUNDLE_DOCS), F.ceil(F.col("g") / BUNDLE_GRAMS), F.lit(1))
    size = size.select("grp", need.cast("long").alias("blocks"), "d", "g")
    small = size.filter("blocks = 1").agg(F.sum("d").alias("d"), F.sum("g").alias("g"))
    total = small.select(F.greatest(F.ceil(F.col("d") * 4 / BUNDLE_DOCS), F.ceil(F.col("g") * 4 / BUNDLE_GRAMS), F.lit(1)).cast("long").alias("n")).first()["n"]
    tile = F.when(F.col("blocks") > 1, -F.col("grp") - 1).otherwise(F.pmod(F.xxhash64("grp"), F.lit(total or 1)))
    bundle = F.pmod(F.xxhash64("digest"), F.col("blocks"))
    return lookup(members, size.select("grp", "blocks"), "grp", ["node"]).select("node", "first", "digest", "n_copies", "grp", "blocks", tile.alias("tile"), bundle.alias("bundle"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents with one of each linked group left, with their own columns.

    Groups are of texts, whatever their ids: the row with the smallest id stays, of several texts under it any one, and a row without an
    id only where none of its group has one. Of rows that repeat both an id and a text one stays. Texts without words link with
    nothing and stay; without an id, each row of them does.
    """
    rows, classes = _linked(docs, doc_id, text, n, threshold, recall)
    classes = checkpoint(classes)
    keep = classes.groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.key")
    keep = keep.unionByName(rows.filter("digest IS NULL AND id IS NOT NULL").select("id", "key").distinct()).select(F.col("id").alias("__id"), F.col("key").alias("__kept"))
    # A text that no other links or equals stays where it stands: only the others, and those without words, are looked up.
    some = lookup(rows.filter("digest IS NOT NULL"), classes.filter("n_links > 0").select("digest"), "digest", ["id", "key"], "left_semi").select("key").union(rows.filter("digest IS NULL").select("key"))
    keyed = let_through(docs.withColumn("__key", _text_key(text)), prefix("__key"), some.select(prefix("key").alias("p")))
    blank = F.col(doc_id).isNull() & ~F.coalesce(F.rlike(F.col(text).cast("string"), F.lit(WORD)), F.lit(False))
    through = keyed.filter(~F.col("__maybe") | blank)
    judged = keyed.filter(F.col("__maybe") & ~blank).dropDuplicates([doc_id, "__key"])
    stay = judged.join(keep, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__kept")), "left_semi")
    return through.unionByName(stay).drop("__key", "__maybe").select(*docs.columns)
