"""Shared helpers: scratch tables in the cluster's shared folder, components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of local sessions without a shared one, by application.
_OWN: dict[str, str] = {}
#: Where tables made by ``saved`` lie.
_SAVED: WeakKeyDictionary = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a folder of its own.
    A cluster without the setting is an error, since a machine-local folder
    would be invisible to the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lakeledger-llm-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unique path for ``name`` below the shared folder."""
    return f"{shared_root(spark)}/lakeledger-llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _SAVED[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``saved`` once nothing reads them: what was derived from them is saved too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_SAVED.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``saved``, in buckets of ``key``: joins on it read the table without shuffling it.

    The catalog entry that carries the bucketing is dropped at once; the files
    stay in the shared folder.
    """
    spark, path, entry = df.sparkSession, scratch(df.sparkSession, name), f"lakeledger_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(entry)
    found = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return found


def share(spark: SparkSession, value):
    """Broadcast an object of this package by value; ``shared`` reads it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(handle):
    """The object behind ``share``, unpickled once per Python worker."""
    if not hasattr(handle, "_object"):
        handle._object = pickle.loads(handle.value)
    return handle._object


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected ``edges(a, b)``.

    Alternating large-star and small-star steps over DataFrames; every step
    sends one row per edge, and a node's neighbours are never gathered in one
    row.  Returns ``(node, comp)`` for every node of an edge, ``comp`` being
    the smallest node of its component; self-loops and NULLs are ignored.
    """
    cur = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where("a is not null and b is not null and a <> b").distinct(), name)
    seen = _digest(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b"), name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        discard(cur)
        cur = saved(small, name)
        discard(large)
        now = _digest(cur)
        if now == seen:
            break
        seen = now
    return (cur.select(F.col("a").alias("node"), F.col("b").alias("comp"))
            .unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                           F.sum(F.hash("a", "b").cast("long"))).first())
