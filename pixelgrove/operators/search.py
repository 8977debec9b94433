"""Vector search: top-k, thresholded pairs, pruned search.

Vectors are compared by cosine in double precision. Both sides of a large
search are cut into blocks of ``BLOCK`` vectors, and each pair of blocks is one
numpy product; a small query side is broadcast instead, after a check of its
size. Each task keeps only its own best k per query before the final ranking.
Pairs above a threshold are looked for in cells around pivots, see
``similar_pairs``; ``pruned_top_k`` reads only the clusters it probes. Ties go to
the smaller id; ids keep their type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from pixelgrove.sources.scratch import stage

BLOCK, MOST_BROADCAST, MOST_PIVOTS = 2048, 4096, 4096


def _matrix(column) -> np.ndarray:
    """Rows of a list column, divided by their lengths; a zero vector stays zero."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), "f8").reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def _best(q: list, d: list, cos: np.ndarray, k: int, floor: float | None) -> Iterator[tuple]:
    order_of = np.array(d)
    for i, row in enumerate(cos):
        pick = np.flatnonzero(row >= floor) if floor is not None else np.arange(len(row))
        if len(pick) > k:
            edge = np.partition(row[pick], len(pick) - k)[len(pick) - k]
            pick = pick[row[pick] >= edge]  # with all ties of the last place
        order = np.lexsort((order_of[pick], -row[pick]))[:k]
        for j in pick[order]:
            yield q[i], d[j], float(row[j])


def _rows(found: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _kind(df: DataFrame, column: str) -> str:
    return df.select(column).schema[0].dataType.simpleString()


def blocks(df: DataFrame, id_col: str, vec_col: str, size: int = BLOCK) -> DataFrame:
    """(block, ids, vectors): the rows packed by a hash of the id, about ``size`` in each."""
    n = max(1, -(-df.count() // size))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("block"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return rows.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("r")).select("block", F.col("r.id").alias("ids"), F.col("r.v").alias("vectors"))


def _block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of queries against every block of rows."""
    a, b = left.toDF("ba", "ids_a", "vectors_a"), right.toDF("bb", "ids_b", "vectors_b")
    return a.crossJoin(b).repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ba", "bb")


def top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query_embedding", scale: str = "os", min_score: float | None = None, exclude_self: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest rows of each query.

    exclude_self: one more neighbour is found and the query's own id is dropped. min_score: least score, inclusive, on ``scale``.
    """
    want, floor = k + int(exclude_self), None if min_score is None else (2 * min_score - 1 if scale == "os" else min_score) - 1e-9
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("v"))
    names, schema = ["query_id", "id", "cos"], f"query_id {_kind(queries, query_id)}, id {_kind(docs, id_col)}, cos double"
    held = q.limit(most_broadcast + 1).toArrow()
    if held.num_rows <= most_broadcast:
        shared = docs.sparkSession.sparkContext.broadcast((held.column("query_id").to_pylist(), held.column("query_id").type, _matrix(held.column("v"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, kind, m = shared.value
            for batch in batches:
                if batch.num_rows and len(asked):
                    yield _rows(list(_best(asked, batch.column("id").to_pylist(), m @ _matrix(batch.column("v")).T, want, floor)), names, [kind, batch.column("id").type, pa.float64()])

        rows = docs.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
        found = rows.mapInArrow(run, schema)
    else:

        def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    a, b = _matrix(batch.column("vectors_a")[i].values), _matrix(batch.column("vectors_b")[i].values)
                    left, right = batch.column("ids_a")[i], batch.column("ids_b")[i]
                    yield _rows(list(_best(left.as_py(), right.as_py(), a @ b.T, want, floor)), names, [left.values.type, right.values.type, pa.float64()])

        found = _block_pairs(blocks(q, "query_id", "v"), blocks(docs, id_col, vec_col)).select("ids_a", "vectors_a", "ids_b", "vectors_b").mapInArrow(run_blocks, schema)
    return _ranking(found, k, want, scale, min_score, exclude_self)


def _ranking(found: DataFrame, k: int, want: int, scale: str, min_score: float | None, exclude_self: bool) -> DataFrame:
    from pixelgrove.functions.vectors import scaled

    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)
    if exclude_self:
        ranked = ranked.where("query_id <> id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = ranked.select("query_id", "id", scaled(F.col("cos"), scale).alias("score"), F.col("rank").cast("long").alias("rank"))
    return out if min_score is None else out.where(F.col("score") >= min_score)


def cells(docs: DataFrame, angle: float, pivots: int, id_col: str, vec_col: str) -> DataFrame:
    """(cell, home, id, v): each row in the cell of its nearest pivot, its home, and in all others within twice the angle.

    Two vectors at no more than ``angle`` from each other then share the home
    cells of both: by the triangle inequality the pivot next to one is at most
    2 * angle farther from the other than that one's own. Pivots are rows picked
    by a hash of their ids, MOST_PIVOTS at most, and broadcast.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(min(pivots, MOST_PIVOTS)).select("v").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(_matrix(picked.column("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            away = np.arccos(np.clip(v @ shared.value.T, -1, 1))
            home = away.argmin(1)
            # a zero vector is as far from all as any: its cosine is 0
            near = away <= away.min(1, keepdims=True) + 2 * angle + 1e-6
            if angle >= np.pi / 2:
                near[:] = True
            i, cell = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype("i8")), pa.array(home[i] == cell), batch.column("id").take(pa.array(i)), batch.column("v").take(pa.array(i))], ["cell", "home", "id", "v"])

    return rows.mapInArrow(run, f"cell long, home boolean, id {_kind(rows, 'id')}, v {_kind(rows, 'v')}")


def similar_pairs(docs: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", scale: str = "os", block: int = BLOCK) -> DataFrame:
    """(a, b, score), a < b, of all pairs with a score of at least ``threshold``.

    Exact, in cells of about ``block`` rows: the narrower the threshold, the fewer
    cells a row is in; far below it is in all of them, and all meet. A cell with
    more rows is cut into chunks, of which each meets each other one.
    """
    from pixelgrove.functions.vectors import scaled

    floor = (2 * threshold - 1 if scale == "os" else threshold) - 1e-9
    dealt = stage(cells(docs, float(np.arccos(np.clip(floor, -1, 1))), -(-docs.count() // block), id_col, vec_col), "cells")
    sizes = dealt.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("n")).where("homes > 0")  # MOST_PIVOTS rows at most
    sizes = sizes.select("cell", F.ceil(F.col("homes") / block).alias("turns"), F.ceil(F.col("n") / block).alias("chunks"))
    rows = dealt.join(F.broadcast(sizes), "cell").withColumns({"turn": F.pmod(F.xxhash64("id"), "turns"), "chunk": F.pmod(F.xxhash64("id"), "chunks")})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("home").select("cell", "turn", every("chunks").alias("chunk"), F.lit(True).alias("left"), "id", "v")
    right = rows.select("cell", every("turns").alias("turn"), "chunk", F.lit(False).alias("left"), "id", "v")

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("left").combine_chunks()
        a, b = group.filter(asks), group.filter(pa.compute.invert(asks))
        x, y = np.array(a.column("id").to_pylist()), np.array(b.column("id").to_pylist())
        cos = _matrix(a.column("v")) @ _matrix(b.column("v")).T if len(x) and len(y) else np.zeros((len(x), len(y)))
        p, q = np.nonzero(cos >= floor)
        smaller = x[p] < y[q]  # a pair is found in the home cells of both: it counts in that of the smaller id
        p, q = p[smaller], q[smaller]
        return pa.table({"a": a.column("id").take(pa.array(p)), "b": b.column("id").take(pa.array(q)), "cos": pa.array(cos[p, q], pa.float64())})

    kind = _kind(docs, id_col)
    found = left.unionByName(right).groupBy("cell", "turn", "chunk").applyInArrow(run, f"a {kind}, b {kind}, cos double").select("a", "b", scaled(F.col("cos"), scale).alias("score"))
    return found.where(F.col("score") >= threshold)


def pruned_top_k(docs: DataFrame, queries: DataFrame, probed: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query_embedding", scale: str = "os", min_score: float | None = None, exclude_self: bool = False) -> DataFrame:
    """Approximate ``top_k``: each query meets the rows of its own clusters only.

    docs have a column cluster_id; where they are stored by it, only the files of
    probed clusters are read. probed: (query_id, cluster_id), see ``clustering.probe``.
    The queries and their clusters are collected, MOST_BROADCAST queries at most.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("v"))
    held = asked.limit(MOST_BROADCAST + 1).toArrow()
    if held.num_rows > MOST_BROADCAST:
        raise ValueError(f"more than {MOST_BROADCAST} queries")
    place = {x: i for i, x in enumerate(held.column("query_id").to_pylist())}
    near: dict[int, list[int]] = {}
    for r in probed.select("query_id", "cluster_id").collect():
        if r.query_id in place:
            near.setdefault(r.cluster_id, []).append(place[r.query_id])
    want, floor = k + int(exclude_self), None if min_score is None else (2 * min_score - 1 if scale == "os" else min_score) - 1e-9
    shared = docs.sparkSession.sparkContext.broadcast((list(place), held.column("query_id").type, _matrix(held.column("v")), near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind, m, of = shared.value
        for batch in batches:
            clusters, ids = batch.column("cluster_id").to_numpy(), batch.column("id")
            for cluster in np.unique(clusters).tolist():
                here = np.flatnonzero(clusters == cluster)
                who = of.get(cluster, [])
                if who:
                    v = _matrix(batch.column("v").take(pa.array(here)))
                    yield _rows(list(_best([names[i] for i in who], ids.take(pa.array(here)).to_pylist(), m[who] @ v.T, want, floor)), ["query_id", "id", "cos"], [kind, ids.type, pa.float64()])

    rows = docs.where(F.col("cluster_id").isin(list(near)) & F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    found = rows.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, f"query_id {_kind(queries, query_id)}, id {_kind(docs, id_col)}, cos double")
    return _ranking(found, k, want, scale, min_score, exclude_self)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: asked, hits and recall of (query_id, id) rows against those of an exact search."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.select("query_id", "id").join(hit, ["query_id", "id"], "left").agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("hits"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def with_source(found: DataFrame, docs: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Search results with further columns of the found rows; vectors stay behind unless they are named."""
    return found.join(docs.select(F.col(id_col).alias("id"), *[c for c in columns if c != id_col]), "id")


def filtered_top_k(docs: DataFrame, queries: DataFrame, k: int, condition: Column, mode: str = "post", columns: list[str] | None = None, **settings) -> DataFrame:
    """Search with a filter. 'post': k neighbours first, then the filter, so fewer may be left. 'pre': the filter first."""
    if mode == "pre":
        return top_k(docs.where(condition), queries, k, **settings)
    found, own = top_k(docs, queries, k, **settings), settings.get("id_col", "id")
    return found.join(docs.where(condition).select(F.col(own).alias("id")), "id", "left_semi")


def nth_object(detections: DataFrame, condition: Column, n: int, image: str = "image_id", order: str = "det_id") -> DataFrame:
    """The n-th (from 0) of the detections that meet a condition, per image; images with fewer have none."""
    rank = Window.partitionBy(image).orderBy(order)
    return detections.where(condition).withColumn("__n", F.row_number().over(rank)).where(F.col("__n") == n + 1).drop("__n")


def verify(pairs: DataFrame, a: str, b: str, threshold: float = 0.6) -> DataFrame:
    """Adds similarity (dot product, 4 decimals) and verified."""
    from pixelgrove.functions.vectors import dot

    raw = dot(F.col(a), F.col(b))
    return pairs.withColumn("similarity", F.round(raw, 4)).withColumn("verified", raw >= threshold)
