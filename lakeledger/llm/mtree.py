"""Exact top-k inner-product search with an M-tree, best first.

Vectors are quantised to integers.  One more coordinate, sqrt(M^2 - |x|^2)
with M the largest norm, turns the largest inner product into the smallest
Euclidean distance, which is a metric.

**Index.**  Rows are split around far-apart pivots, level by level, until a
cell holds TREE rows at most; a cell of copies of one vector, which no pivot
splits, is dealt by hash.  The number of levels grows with the logarithm of
the rows.  A cell is a subtree: one task cuts it along its widest direction
into pages of PAGE entries.  A page is a row with its centre, its covering
radius, its distance to the subtree's centre, and its entries with their
distances to the page's centre.  The directory is a table of the subtrees'
centres and covering radii.

**Search.**  A query first visits the subtree with the nearest centre; its
k-th score there bounds the rest.  Then it is sent only to subtrees whose
smallest possible distance is within that bound.  In a subtree, pages are
visited in order of their smallest possible distance, until that exceeds the
k-th best so far; the stored distances and the triangle inequality leave out
pages before the distance to their centre is computed, and entries before
their product is.  Queries of a block do this together, as matrix products of
those that visit the same page.  Scores are exact integers.

How much the bounds leave out is up to the data: vectors without structure
(uniform in many dimensions) have no near neighbours to speak of, and every
query meets most pages.  Traffic is then one row per query and subtree, and
one per page and block of QUERY_BLOCK queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeledger.llm.common import discard, saved
from lakeledger.llm.registry import register, table

#: Entries of a leaf page and rows of a subtree, at most; queries of a block and directory rows of a block, about.
PAGE, TREE, QUERY_BLOCK, NODE_BLOCK = 256, 8192, 4096, 4096
#: Rows of a cell read to choose pivots, those with the smallest hash; pivots of a split.
SAMPLE, PIVOTS = 512, 32
#: Levels of splits after which what is left is dealt by hash.
LEVELS = 16
#: Components beyond this are refused: their squares leave the range of doubles.
LARGEST = 2.0 ** 400
#: Products of norms below this are exact in doubles.
EXACT = 2.0 ** 52

_NONE, _NOBODY = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_ROW = "vec_id long, v binary, norm double, key binary"


def quantised(vectors: DataFrame, every: int, scale: int = 256) -> DataFrame:
    """``vec_id, v, norm, key``: floor(scale * x) of every component as doubles, which hold it exactly.

    NULL or empty vectors, and those with NULL or non-finite components, are
    left out.  ``key`` orders the vectors of queries as arrays are ordered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, norms, keys = [], [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                v = None if i is None or not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(float)
                if v is None or not len(v) or not np.isfinite(v).all():  # a NULL component comes as NaN
                    continue
                if np.abs(v).max() * scale > LARGEST:
                    raise ValueError(f"vector {i} has a component beyond 2**400 / {scale}")
                v = np.floor(v * scale) + 0.0  # no negative zeros
                ids.append(i)
                out.append(v.tobytes())
                norms.append(float(np.sqrt((v * v).sum())))
                bits = v.view(np.int64)
                sortable = (bits ^ ((bits >> 63) & np.int64(_NOBODY))).view(np.uint64) ^ np.uint64(1 << 63)
                keys.append(sortable.astype(">u8").tobytes() if i % every == 0 else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(norms, pa.float64()), pa.array(keys, pa.binary())],
                                             names=["vec_id", "v", "norm", "key"])

    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return src.mapInArrow(run, _ROW)


def _matrix(col: pa.Array) -> np.ndarray:
    rows = col.to_pylist()
    if not rows:
        return np.empty((0, 0))
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes all norms equal to ``top``."""
    return np.column_stack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def slack(top: float, dim: int) -> float:
    """What rounding may add to or take from a distance: squares are off by some 2**-52 of top**2 each."""
    return 4 * top * np.sqrt((dim + 16) * 2.0 ** -52)


def spread(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of k far-apart points at most, the farthest from all chosen so far each time."""
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def cells(rows: DataFrame, top: float) -> DataFrame:
    """``rows`` with ``cell``: groups of near vectors, about TREE rows at most."""
    def pivots(t: pa.Table) -> pa.Table:
        x = lifted(_matrix(t.column("v").combine_chunks()), top)
        return pa.table({"cell": t.column("cell")[:1], "width": pa.array([x.shape[1]], pa.int32()),
                         "pivots": pa.array([spread(x, PIVOTS).tobytes()], pa.binary())})

    def assign(t: pa.Table, p: pa.Table) -> pa.Table:
        old, names = t.column("cell"), []
        if t.num_rows:
            found = np.frombuffer(p.column("pivots")[0].as_py()).reshape(-1, p.column("width")[0].as_py())
            if len(found) > 1:
                part = distances(lifted(_matrix(t.column("v").combine_chunks()), top), found).argmin(1).tolist()
                names = [f"{old[0].as_py()}/{x}" for x in part]
            else:  # copies of one vector
                names = [f"{old[0].as_py()}/h{t.column('salt')[0].as_py()}"] * t.num_rows
        return t.select(columns).append_column("cell", pa.array(names, pa.string()))

    columns = rows.columns
    cur = saved(rows.withColumn("cell", F.lit("")), "mtree-cells")
    for level in range(LEVELS + 1):
        big = saved(cur.groupBy("cell").agg(F.ceil(F.count("*") / TREE).cast("int").alias("parts")).where("parts > 1"), "mtree-big")
        if big.isEmpty():
            return cur
        salted = cur.join(big, "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
        if level == LEVELS:
            split = salted.withColumn("cell", F.concat_ws("/h", "cell", "salt")).select(*columns, "cell")
        else:
            order = Window.partitionBy("cell").orderBy(F.xxhash64("vec_id", "v"), "vec_id")
            some = salted.select("cell", "v", "vec_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE)
            chosen = some.groupBy("cell").applyInArrow(pivots, "cell string, width int, pivots binary")
            chosen = chosen.join(big, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            split = salted.groupBy("cell", "salt").cogroup(chosen.groupBy("cell", "salt")).applyInArrow(
                assign, f"{_ROW}, cell string")
        was, cur = cur, saved(cur.join(big, "cell", "left_anti").select(*columns, "cell").unionByName(split), "mtree-cells")
        discard(was, big)
    return cur


def paged(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers in pages: halves along the line between two far points, until they hold PAGE rows at most."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= PAGE:
            out.append(at)
            continue
        part = x[at]
        a = part[((part - part[0]) ** 2).sum(1).argmax()]
        b = part[((part - a) ** 2).sum(1).argmax()]
        order = np.argsort(part @ (b - a), kind="stable")
        todo += [at[order[len(at) // 2:]], at[order[:len(at) // 2]]]
    return out


_PAGE = ("cell string, page int, centre binary, radius double, to_parent double, largest double, ids binary, entries binary, "
         "to_centre binary, parent binary, reach double")


def build(rows: DataFrame, top: float) -> DataFrame:
    """The index: one row per page, with its subtree's centre (``parent``) and covering radius (``reach``)."""
    def tree(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("v", "ascending")]).combine_chunks()
        raw, ids = _matrix(t.column("v").chunk(0)), t.column("vec_id").to_numpy()
        x, norm = lifted(raw, top), t.column("norm").to_numpy()
        parent = x.mean(0, keepdims=True)
        reach = float(distances(x, parent).max())
        out = []
        for n, at in enumerate(paged(x)):
            centre = x[at].mean(0, keepdims=True)
            d = distances(x[at], centre)[:, 0]
            out.append((t.column("cell")[0].as_py(), n, centre.tobytes(), float(d.max()), float(distances(centre, parent)[0, 0]), float(norm[at].max()),
                        ids[at].astype(np.int64).tobytes(), raw[at].tobytes(), d.tobytes(), parent.tobytes(), reach))
        return pa.table(list(map(list, zip(*out))), schema=schema)

    types = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _PAGE.split(", ")])
    return saved(cells(rows, top).groupBy("cell").applyInArrow(tree, _PAGE), "mtree-pages")


def _scores(q: np.ndarray, q_norm: np.ndarray, entries: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products as longs; a score below the range of a long is _NONE, one above it an error."""
    out = np.empty((len(q), len(entries)), np.int64)
    plain = q_norm * largest < EXACT
    out[plain] = (q[plain] @ entries.T).astype(np.int64)
    if not plain.all():
        wide = np.array([[int(c) for c in r] for r in entries], object).T
        for i in np.flatnonzero(~plain):
            exact = np.array([int(c) for c in q[i]], object) @ wide
            if max(exact) > _NOBODY:
                raise OverflowError("a score is beyond the range of a long")
            out[i] = [max(s, _NONE) for s in exact]
    return out


def search(ids: np.ndarray, raw: np.ndarray, floor: np.ndarray, pages: list[dict], top: float, k: int) -> list[np.ndarray]:
    """The k best of one subtree for every query of a block: query, score, vec.

    ``floor`` is a score that k vectors elsewhere reach (_NONE: none known);
    what can't reach it may be left out."""
    m, eps = len(ids), slack(top, raw.shape[1])
    best, who = np.full((m, k), _NONE), np.full((m, k), _NOBODY)
    norm, lift = np.sqrt((raw * raw).sum(1)), np.column_stack([raw, np.zeros(m)])
    centre, radius, stored = (np.array([p[c] for p in pages]) for c in ("centre", "radius", "to_parent"))

    def limit(at: np.ndarray) -> np.ndarray:
        """Distance beyond which nothing can enter or tie."""
        last = np.maximum(best[at, -1], floor[at])
        return np.where(last == _NONE, np.inf, np.sqrt(np.maximum(norm[at] ** 2 + top * top - 2.0 * last, 0)) + eps)

    every = np.arange(m)
    # From the stored distances first: a page they leave out needs no distance to its centre.
    low = np.abs(distances(lift, pages[0]["parent"][None, :]) - stored[None, :]) - radius[None, :] - eps
    d = np.full(low.shape, np.inf)
    for j in range(len(pages)):
        at = np.flatnonzero(low[:, j] <= limit(every))
        d[at, j] = distances(lift[at], centre[j:j + 1])[:, 0]
        low[at, j] = np.maximum(low[at, j], d[at, j] - radius[j] - eps)
    low[np.isinf(d)] = np.inf
    while True:
        page = low.argmin(1)
        going = np.flatnonzero(low[every, page] <= limit(every))
        going = going[np.isfinite(low[going, page[going]])]
        if not len(going):
            break
        for j in np.unique(page[going]):
            at, p = going[page[going] == j], pages[j]
            low[at, j] = np.inf
            near = np.abs(d[at, j][:, None] - p["to_centre"][None, :]) <= limit(at)[:, None] + eps
            cols = np.flatnonzero(near.any(0))
            if not len(cols):
                continue
            score, vec = _scores(raw[at], norm[at], p["entries"][cols], p["largest"]), p["ids"][cols]
            last, last_who = best[at, -1][:, None], who[at, -1][:, None]
            enters = near[:, cols] & ((score > last) | ((score == last) & (vec[None, :] < last_who))) & (vec[None, :] != ids[at][:, None])
            r, c = np.nonzero(enters)
            rows = np.r_[np.repeat(np.arange(len(at)), k), r]
            s, v = np.r_[best[at].ravel(), score[r, c]], np.r_[who[at].ravel(), vec[c]]
            order = np.lexsort((v, ~s, rows))
            rows = rows[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = order[place < k]
            best[at], who[at] = s[keep].reshape(-1, k), v[keep].reshape(-1, k)
    r, c = np.nonzero(who != _NOBODY)
    if (best[r, c] == _NONE).any():
        raise OverflowError("a score is beyond the range of a long")
    return [ids[r], best[r, c], who[r, c]]


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def route(queries: DataFrame, nodes: DataFrame, top: float, blocks: int, first: bool) -> DataFrame:
    """``(query_id, cell, low, at)`` of the subtrees that a query has to visit.

    ``first``: the one with the nearest centre (of each block of directory
    rows); else all that its ``floor`` doesn't rule out."""
    node_blocks = _blocks(nodes.count(), NODE_BLOCK)
    left = queries.withColumn("nb", F.explode(F.sequence(F.lit(0), F.lit(node_blocks - 1))))
    right = (nodes.withColumn("nb", F.pmod(F.hash("cell"), F.lit(node_blocks)))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def run(q: pa.Table, n: pa.Table) -> pa.Table:
        out = [[], [], []]
        if q.num_rows and n.num_rows:
            raw, ids = _matrix(q.column("v").combine_chunks()), q.column("query_id").to_numpy()
            d = distances(np.column_stack([raw, np.zeros(len(raw))]), _matrix(n.column("parent").combine_chunks()))
            eps = slack(top, raw.shape[1])
            if first:
                r, c = np.arange(len(raw)), d.argmin(1)
            else:
                floor = q.column("floor").to_numpy().astype(float)
                limit = np.where(floor == float(_NONE), np.inf, np.sqrt(np.maximum((raw * raw).sum(1) + top * top - 2 * floor, 0)) + eps)
                r, c = np.nonzero(d - n.column("reach").to_numpy()[None, :] - eps <= limit[:, None])
            out = [pa.array(ids[r]), n.column("cell").combine_chunks().take(pa.array(c)), pa.array(d[r, c])]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "cell": pa.array(out[1], pa.string()), "d": pa.array(out[2], pa.float64())})

    return left.groupBy("qb", "nb").cogroup(right.groupBy("qb", "nb")).applyInArrow(run, "query_id long, cell string, d double")


def visit(pairs: DataFrame, queries: DataFrame, pages: DataFrame, top: float, k: int) -> DataFrame:
    """``(query_id, score, vec_id)``: the k best of each query in each subtree of ``pairs(query_id, cell)``."""
    left = saved(pairs.select("query_id", "cell").join(queries, "query_id"), "mtree-visits")
    # A page goes only to the query blocks that visit it.
    asked = left.groupBy(F.col("cell").alias("asked"), (F.col("qb") + 0).alias("block")).agg(F.count("*").alias("n"))
    right = pages.join(asked, F.col("cell") == F.col("asked")).drop("asked", "n")

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        got = [[], [], []]
        if q.num_rows and p.num_rows:
            raw = _matrix(q.column("v").combine_chunks())
            kinds = {"centre": float, "parent": float, "to_centre": float, "entries": float, "ids": np.int64}
            nodes = [{c: np.frombuffer(x, kinds[c]) if c in kinds else x for c, x in r.items()} for r in p.sort_by("page").to_pylist()]
            for x in nodes:
                x["entries"] = x["entries"].reshape(len(x["ids"]), -1)
                if x["entries"].shape[1] != raw.shape[1]:
                    raise ValueError("vectors of different lengths")
            got = search(q.column("query_id").to_numpy(), raw, q.column("floor").to_numpy(), nodes, top, k)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "score", "vec_id"), got)})

    return left.groupBy("cell", "qb").cogroup(right.groupBy("cell", "block")).applyInArrow(run, "query_id long, score long, vec_id long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """For each query its ``k`` best other vectors by integer inner product.

    ``vectors`` has ``vec_id`` and ``embedding``; queries are the rows whose
    vec_id is divisible by ``every``.  Returns ``query_id, rank, vec_id,
    score``; ties go to the smaller vec_id, and fewer vectors give fewer rows.
    Vectors that are NULL, empty or hold NULL or non-finite components take no
    part, nor do rows with a NULL vec_id.  Rows that repeat a vec_id are
    candidates of their own, but never for a query of the same vec_id, and
    repeated queries are one query (of the row with the smallest vector).  All
    vectors that take part have one length, else the job fails.  Finite
    components of any size up to 2**400 count exactly; the job fails where a
    score of the result is beyond the range of a long.
    """
    spark = vectors.sparkSession
    rows = saved(quantised(vectors, every, scale), "mtree-vectors")
    top = rows.agg(F.max("norm")).first()[0]
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top *= 1 + 1e-12  # no vector is longer, whatever the rounding of its norm
    pages = build(rows, top)
    nodes = saved(pages.where("page = 0").select("cell", "parent", "reach"), "mtree-directory")
    queries = rows.where("key is not null").groupBy("vec_id").agg(F.min_by("v", "key").alias("v")).withColumnRenamed("vec_id", "query_id")
    queries = saved(queries.withColumn("floor", F.lit(_NONE)), "mtree-queries")
    blocks = _blocks(queries.count(), QUERY_BLOCK)
    queries = queries.withColumn("qb", F.pmod(F.hash("query_id", F.lit(3)), F.lit(blocks)))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    near = route(queries, nodes, top, blocks, True).groupBy("query_id").agg(F.min_by("cell", F.struct("d", "cell")).alias("cell"))
    near = saved(near, "mtree-near")
    found = saved(visit(near, queries, pages, top, k), "mtree-found")
    floor = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    bounded = queries.drop("floor").join(floor, "query_id", "left").select("query_id", "v", F.coalesce("least", F.lit(_NONE)).alias("floor"), "qb")
    bounded = saved(bounded, "mtree-bounded")
    others = saved(route(bounded, nodes, top, blocks, False).join(near, ["query_id", "cell"], "left_anti"), "mtree-others")
    rest = visit(others, bounded, pages, top, k)
    best = found.unionByName(rest).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op6_mtree_top_k", ORACLE_OP6)
def op6_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of every 50th vector."""
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)
