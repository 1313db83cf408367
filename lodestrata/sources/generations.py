"""Immutable generations of a graph: written once under a key, found, checked and read back.

A generation is a folder ``generation_key=<key>`` with one table per kind and a
meta row. Writers stage under another name and rename, so that a key is there in
whole or not at all; readers only see committed keys. Rows are partitioned by
the key alone and sorted by source within files, so that lookups prune.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import ids
from lodestrata.lineage import cut


def generation_key(schema_version: int, digests: list[str]) -> str:
    """The key of a schema version (2 bytes, big-endian) and digests, each after its length."""
    import hashlib

    h = hashlib.sha256()
    for part in (b"repository-graph-generation/v1", schema_version.to_bytes(2, "big"), *[d.encode() for d in digests]):
        h.update(len(part).to_bytes(8, "big") + part)
    return h.hexdigest()


def root_hash(rows: DataFrame, columns: list[str], most: int = 50_000) -> DataFrame:
    """One row (rows, root): a hash over the rows in canonical order.

    Equal rows are hashed once with their number. Hashes are put into blocks by
    their first digits, as many as keep a block at about half of ``most``, sorted
    and chained; blocks are chained in levels of 4,096 up to the root. The order of
    the input does not matter, and no task holds more than a block at once.
    """
    hashed = rows.select(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("key"))
    per = cut(hashed.groupBy("key").agg(F.count("*").alias("rows"))).withColumn("d", F.concat_ws(":", "key", "rows"))
    n, digits = per.count(), 0
    while 16**digits * most < 2 * n:
        digits += 1
    chained = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "d"))), lambda x: F.concat_ws("=", x["key"], x["d"])), ","), 256)
    while digits > 0:
        per = per.groupBy(F.substring("key", 1, digits).alias("key")).agg(F.sum("rows").alias("rows"), chained.alias("d"))
        digits -= 3
    return per.agg(F.sum("rows").alias("rows"), chained.alias("root"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(tables: dict[str, DataFrame], root: str, key: str) -> str:
    """``published``, or ``reused`` if the key is there already. Counts are written with the tables."""
    spark = next(iter(tables.values())).sparkSession
    jvm, fs = _fs(spark, root)
    final = jvm.org.apache.hadoop.fs.Path(f"{root}/generation_key={key}")
    if fs.exists(final):
        return "reused"
    stage = f"{root}/_staging-{key}-{spark.sparkContext.applicationId}"
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{stage}/{name}")
        counts.append((name, spark.read.parquet(f"{stage}/{name}").count()))
    spark.createDataFrame(counts, "table string, rows bigint").coalesce(1).write.mode("overwrite").parquet(f"{stage}/meta")
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(root))
    staged = jvm.org.apache.hadoop.fs.Path(stage)
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, True)
        return "reused"
    return "published"


def read(spark: SparkSession, root: str, key: str, table: str) -> DataFrame:
    """A table of a committed generation."""
    return spark.read.parquet(f"{root}/generation_key={key}/{table}")


def reconcile(spark: SparkSession, root: str, key: str) -> DataFrame:
    """(table, rows, found, matches) of a generation's tables against its meta rows."""
    meta = read(spark, root, key, "meta")
    found = [(r.table, read(spark, root, key, r.table).count()) for r in meta.collect()]
    return meta.join(spark.createDataFrame(found, "table string, found bigint"), "table").withColumn("matches", F.col("rows") == F.col("found"))


def locate(candidates: DataFrame, wanted: str) -> DataFrame:
    """The generation to use: the exact key, else the most complete, ties to the least key."""
    exact = F.when(F.col("generation_key") == wanted, 0).otherwise(1)
    return candidates.orderBy(exact, F.desc("completeness"), "generation_key").limit(1)


def put_facts(store: DataFrame | None, facts: DataFrame) -> DataFrame:
    """A store of facts by content key; the first written under a key stays."""
    both = facts.withColumn("__new", F.lit(1)) if store is None else store.withColumn("__new", F.lit(0)).unionByName(facts.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("fact_key").orderBy("__new", "payload")
    return cut(both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__new"))


def get_facts(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fact_key, status, payload): hit, miss, stale (other version) or corrupt (digest does not match)."""
    j = wanted.select("fact_key", "version").join(store.select("fact_key", F.col("version").alias("held"), "payload", "digest"), "fact_key", "left")
    good = F.sha2("payload", 256) == F.col("digest")
    status = F.when(F.col("held").isNull(), "miss").when(~good, "corrupt").when(F.col("held") != F.col("version"), "stale").otherwise("hit")
    return j.select("fact_key", status.alias("status"), F.when(status == "hit", F.col("payload")).alias("payload"))


def fact_key(language: str, content: str, versions: list[str]):
    """The key of a file's facts: language, content digest and the versions of what reads it."""
    return ids.prefixed_digest(F.lit("file-facts/v1"), language, content, *[F.lit(v) for v in versions])
