"""Extendible hashing into shards of bounded size.

The directory is indexed by the leading bits of a row's hash.  A bucket
splits on its next bit only while it is over the byte limit, so shards have
prefixes of different lengths.  The sizes of all prefixes come from one
aggregation over fine cells, ``STEP`` bits at a time; only the rows of cells
that are still too large take part in the next step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeledger.llm.common import saved
from lakeledger.llm.registry import register, table

#: Bits of the hash (from md5, so that other engines can compute it).
HASH_BITS = 60
#: Bits that one pass over the rows adds to the directory.
STEP = 12
#: Rows of one hash whose running sum one task makes, about.
BLOCK = 10_000


def hash_bits(key: str):
    """The first ``HASH_BITS`` bits of the md5 of a column's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def shards(rows: DataFrame, key: str, n_bytes: str, limit: int) -> DataFrame:
    """Assign every row to a shard of at most ``limit`` bytes.

    Adds ``shard_depth`` (bits of the prefix), ``shard_prefix`` (their value)
    and ``shard_part``.  ``n_bytes`` names a column with the row's size, NULL
    counting 0.  Rows with one hash cannot be split by bits: if together they
    exceed the limit, they are laid end to end and cut at its multiples: the
    rows between two cuts are one part, a row across a cut is a part of its
    own (``shard_part``, 0 everywhere else).  So only a single row that is
    larger itself is over the limit.
    NULL keys count as the empty text.  All rows and columns stay.
    """
    base = rows.withColumn("__h", hash_bits(key)).withColumn("__s", F.coalesce(F.col(n_bytes), F.lit(0)).cast("long"))
    todo = base.groupBy("__h").agg(F.sum("__s").alias("s"), F.count("*").alias("m"))
    todo = saved(todo.withColumnRenamed("__h", "h"), "shard-hashes")
    found, depth = None, 0
    while True:
        deep = min(depth + STEP, HASH_BITS)
        cell = F.shiftright("h", HASH_BITS - deep)
        cells = todo.groupBy(cell.alias("cell")).agg(F.sum("s").alias("s"))
        # Sizes of all prefixes of this step's lengths; the root only at first.
        sizes = (cells.withColumn("d", F.explode(F.sequence(F.lit(depth + (depth > 0)), F.lit(deep))))
                 .groupBy("d", F.expr(f"shiftright(cell, {deep} - d)").alias("p")).agg(F.sum("s").alias("s")))
        fits = sizes.where((F.col("s") <= limit) | (F.col("d") == HASH_BITS)).select("d", "p")
        per = cells.withColumn("d", F.explode(F.sequence(F.lit(depth + (depth > 0)), F.lit(deep)))).withColumn("p", F.expr(f"shiftright(cell, {deep} - d)"))
        chosen = per.join(fits, ["d", "p"]).groupBy("cell").agg(F.min("d").alias("depth"))
        marked = todo.withColumn("cell", cell).join(chosen, "cell", "left").drop("cell")
        marked = saved(marked, "shard-step")
        done = marked.where("depth is not null")
        found = done if found is None else found.unionByName(done)
        todo = marked.where("depth is null").drop("depth")
        depth = deep
        if depth >= HASH_BITS or todo.isEmpty():
            break
    over = (F.col("depth") == HASH_BITS) & (F.col("s") > limit)
    blocks = F.when(over, F.ceil(F.col("m") / BLOCK)).otherwise(0)
    directory = saved(found.select(F.col("h").alias("__h"), "depth", blocks.alias("__blocks")), "shard-directory")

    def placed(part_rows: DataFrame) -> DataFrame:
        return (part_rows.withColumn("shard_depth", F.col("depth").cast("int"))
                .withColumn("shard_prefix", F.expr(f"shiftright(__h, {HASH_BITS} - depth)"))
                .withColumn("shard_part", F.col("__part").cast("int"))
                .select(*[c for c in rows.columns if c not in ("shard_depth", "shard_prefix", "shard_part")], "shard_depth", "shard_prefix", "shard_part"))

    hot = directory.where("__blocks > 0")
    if hot.isEmpty():
        return placed(base.join(directory, "__h").withColumn("__part", F.lit(0)))
    # Running sums within blocks, then over the blocks of a hash; saved, so that one numbering of the rows serves both.
    dealt = (base.withColumn("__i", F.monotonically_increasing_id()).join(hot, "__h")
             .withColumn("__b", F.pmod(F.xxhash64("__i"), F.col("__blocks"))))
    dealt = saved(dealt.withColumn("__end", F.sum("__s").over(Window.partitionBy("__h", "__b").orderBy("__i"))), "shard-blocks")
    sums = dealt.groupBy("__h", "__b").agg(F.sum("__s").alias("__sum"))
    sums = sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy("__h").orderBy("__b")) - F.col("__sum")).drop("__sum")
    cut = dealt.join(sums, ["__h", "__b"]).withColumn("__end", F.expr("__end + __before"))
    first, last = f"(__end - __s) div {int(limit)}", f"greatest(__end - 1, __end - __s) div {int(limit)}"
    cut = cut.withColumn("__part", F.expr(f"2 * ({first}) + if({first} = {last}, 0, 1)"))
    rest = base.join(directory.where("__blocks = 0"), "__h").withColumn("__part", F.lit(0))
    return placed(rest).unionByName(placed(cut))


def write_shards(rows: DataFrame, path: str, key: str, n_bytes: str, limit: int) -> None:
    """Write the rows as Parquet, one folder per shard."""
    out = shards(rows, key, n_bytes, limit)
    cols = ["shard_depth", "shard_prefix", "shard_part"]
    out.repartition(*cols).write.partitionBy(*cols).parquet(path)


LIMIT = 1_000_000

ORACLE_OP2 = f"""
WITH r AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HASH_BITS // 4})) AS BIGINT) AS h,
    CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
x AS (SELECT doc_id, h, n_bytes, d, h >> CAST({HASH_BITS} - d AS BIGINT) AS p FROM r, (SELECT unnest(range(0, {HASH_BITS} + 1)) AS d)),
z AS (SELECT *, sum(n_bytes) OVER (PARTITION BY d, p) AS s FROM x)
SELECT doc_id, any_value(n_bytes) AS n_bytes, CAST(min(d) AS INTEGER) AS shard_depth, CAST(min_by(p, d) AS BIGINT) AS shard_prefix,
  CAST(0 AS INTEGER) AS shard_part
FROM z WHERE s <= {LIMIT} GROUP BY doc_id
UNION ALL
SELECT doc_id, n_bytes, CAST({HASH_BITS} AS INTEGER), CAST(p AS BIGINT), CAST(1 AS INTEGER) FROM z WHERE d = {HASH_BITS} AND s > {LIMIT}
"""


@register("op2_extendible_shards", ORACLE_OP2)
def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, shards of at most 1 MB of text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return shards(docs, "doc_id", "n_bytes", LIMIT)
