"""What the operators share on the cluster: checkpoints, lookups that hot keys don't slow, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import shared_folder

#: A lookup's keys with more rows than HOT_ROWS, the HOT_KEYS most frequent at most, are salted: no other has more than a HOT_KEYS-th of all rows.
HOT_KEYS, HOT_ROWS, SALTS = 1000, 1000, 64
#: Prefixes of hashes by which rows are let through before a shuffle: a table of this many numbers at most is broadcast.
PREFIXES = 1 << 20


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows are written to the shared folder, so a lost executor takes nothing along."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys of a lookup that are salted."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS).select(key)


def lookup(rows: DataFrame, table: DataFrame, key: str, by: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Rows joined with a table that has one row a key. Rows of hot keys are dealt by a hash of ``by`` over SALTS parts, each with a copy of the
    key's row; which keys are hot is a list of HOT_KEYS at most. It is asked for at once, so rows (or ``hot``) should be cheap to read."""
    names = (hot_keys(rows, key) if hot is None else hot).select(F.col(key).alias("__hot"))
    found = names.collect()
    if not found:
        return rows.join(table, key, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(found, names.schema))
    left = rows.join(few, F.col(key) == F.col("__hot"), "left")
    left = left.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))).drop("__hot")
    right = table.join(few, F.col(key) == F.col("__hot"), "left")
    every = F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return left.join(right.withColumn("__salt", F.explode(every)).drop("__hot"), [key, "__salt"], how).drop("__salt")


def prefix(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(PREFIXES)).cast("int")


def let_through(rows: DataFrame, mark: Column, wanted: DataFrame) -> DataFrame:
    """rows and ``__maybe``: false only where no wanted prefix (a column ``p``) equals the mark, so those rows need not be shuffled.

    The table of prefixes has PREFIXES rows at most, whatever the corpus. Where nearly all are wanted, nearly all rows pass.
    """
    few = F.broadcast(wanted.select(F.col("p").alias("__p")).distinct().withColumn("__maybe", F.lit(True)))
    return rows.join(few, mark == F.col("__p"), "left").drop("__p").withColumn("__maybe", F.coalesce("__maybe", F.lit(False)))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable by links, for each id in edges(u, v) of whole numbers.

    Minimum labels over links, then one pointer jump, until nothing changes. Only (id, label) rows move; minima are made before the
    shuffle, and hubs and labels that many ids share are looked up in salted parts. Null ends are ignored; loops are allowed; an empty
    table has no components. Each round at least one label falls, so it ends whatever the links.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).dropna()
    both = checkpoint(edges.union(edges.select("v", "u")).distinct())
    if both.isEmpty():
        return spark.createDataFrame([], "id long, component long")
    hubs = spark.createDataFrame(hot_keys(both, "v").collect(), "v long")  # HOT_KEYS rows at most
    label = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")))
    while True:
        near = lookup(both, label.select(F.col("u").alias("v"), "l"), "v", ["u"], hot=hubs).groupBy("u").agg(F.min("l").alias("m"))
        least = label.join(near, "u").select("u", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        root = label.join(near, "u").select(F.col("u").alias("l"), F.least("l", "m").alias("r"))
        label = checkpoint(lookup(least, root, "l", ["u"], hot=hot_keys(label, "l")).select("u", "was", F.col("r").alias("l")))
        if label.filter("was <> l").isEmpty():
            return label.select(F.col("u").alias("id"), F.col("l").alias("component"))
        label = label.select("u", "l")


def with_least_ids(classes: DataFrame) -> DataFrame:
    """Classes (rep, component, ...) and ``component_id``: the least rep of the component. Components whose classes share a rep, as where rows of
    unlike contents share an id, count as one. Null reps count only where there is no other."""
    low = classes.groupBy("component").agg(F.min("rep").alias("low"))
    shared = classes.filter("rep IS NOT NULL").groupBy("rep").agg(F.min("component").alias("v"), F.max("component").alias("u")).filter("u <> v").select("rep", "v")
    merged = components(classes.join(shared, "rep").select(F.col("component").alias("u"), "v")).select(F.col("id").alias("component"), F.col("component").alias("joint"))
    low = low.join(merged, "component", "left").withColumn("joint", F.coalesce("joint", "component"))
    least = low.groupBy("joint").agg(F.min("low").alias("component_id"))
    low = low.join(least, "joint").select("component", "component_id")
    return lookup(classes, low, "component", ["rep"])
