"""Exact top-k inner products by dual-tree search over a cover tree.

A cover tree is fitted on a bounded sample, the deeper the more rows there are; every row, query or candidate,
is then filed under its nearest leaf, and the leaves' covering radii are taken over all rows, so bounds hold for
all of them. Queries get a first kth score from blocks of the leaves nearest to their own. Then pairs of nodes
are descended together: a pair is pruned when <a, b> + r_a |b| + r_b |a| + r_a r_b, the most that any of its
products can be, is below the worst kth score of the query group. Only blocks of the surviving pairs meet, and
of a block's queries only those whose own bound on the other block reaches their kth score are multiplied.

Leaves hold any number of rows: they are cut into blocks by hash, so no task gathers a whole leaf. Vectors with
components so large that doubles would round their products stand beside the tree: they meet all blocks, in
whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.shared import stored

SAMPLE = 8192  # vectors that the tree is fitted on
LEAF_ROWS = 512  # rows of a leaf, about, up to MAX_LEAVES
MIN_LEAVES, MAX_LEAVES = 16, 1024
SEEDS = 3  # leaves that first kth scores come from
BLOCK = 4096  # candidates of a leaf that are multiplied at once, about; fewer in small tables
QUERY_BLOCK = 1024
EXACT = float(1 << 52)  # up to here doubles add whole numbers exactly
LONG = (1 << 63) - 1
BESIDE = -1  # the leaf of large vectors


class CoverTree:
    """Centres by level: each level's centres lie further apart than its scale, half of that above."""

    def __init__(self, sample: np.ndarray, leaves: int = MIN_LEAVES):
        self.centre: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves: list[int] = []
        if not len(sample):
            return
        chosen = [0]
        near = np.linalg.norm(sample - sample[0], axis=1)
        self._node(sample[0])
        level = {0: 0}  # chosen point -> its node on this level
        scale = float(near.max())
        while scale > 1e-9 and len(chosen) < leaves:
            scale /= 2
            above = dict(level)
            level = {}
            for p, node in above.items():
                level[p] = self._node(sample[p], node)
            points = list(above)
            while len(chosen) < leaves and near.max() > scale:
                far = int(near.argmax())
                parent = points[int(np.linalg.norm(sample[points] - sample[far], axis=1).argmin())]
                level[far] = self._node(sample[far], above[parent])
                chosen.append(far)
                near = np.minimum(near, np.linalg.norm(sample - sample[far], axis=1))
        self.leaves = [i for i, own in enumerate(self.children) if not own]

    def _node(self, centre: np.ndarray, parent: int | None = None) -> int:
        self.centre.append(centre.astype(np.float64))
        self.children.append([])
        if parent is not None:
            self.children[parent].append(len(self.centre) - 1)
        return len(self.centre) - 1

    def file(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest leaf of each row and its distance."""
        centres = np.stack([self.centre[i] for i in self.leaves])
        squares = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)
        best = squares.argmin(axis=1)
        return np.array(self.leaves)[best], np.linalg.norm(rows - centres[best], axis=1)

    def nearest(self, leaf: int, rows: dict[int, int], k: int) -> list[int]:
        """The k leaves with rows whose centres are nearest to a leaf's, itself first."""
        there = [x for x in self.leaves if rows.get(x)]
        far = np.linalg.norm(np.stack([self.centre[x] for x in there]) - self.centre[leaf], axis=1)
        return [there[i] for i in np.argsort(far, kind="stable")[:k]]

    def pairs(self, query_radius: dict[int, float], worst: dict[int, float], radius: dict[int, float]) -> list[tuple[int, int]]:
        """Leaf pairs (query, candidate) that the bounds leave. Leaves without rows are absent from the radii."""
        n = len(self.centre)

        def lifted(own: dict[int, float]) -> list[float]:
            out = [-1.0] * n  # -1: no rows below
            for i in reversed(range(n)):
                out[i] = own.get(i, -1.0) if not self.children[i] else max((out[c] + float(np.linalg.norm(self.centre[c] - self.centre[i])) for c in self.children[i] if out[c] >= 0), default=-1.0)
            return out

        rq, rc = lifted(query_radius), lifted(radius)
        least = [np.inf] * n
        for i in reversed(range(n)):
            least[i] = worst.get(i, np.inf) if not self.children[i] else min(least[c] for c in self.children[i])
        norm = [float(np.linalg.norm(c)) for c in self.centre]
        found, todo = [], [(0, 0)] if n else []
        while todo:
            q, c = todo.pop()
            if rq[q] < 0 or rc[c] < 0:
                continue
            most = float(self.centre[q] @ self.centre[c]) + rq[q] * norm[c] + rc[c] * norm[q] + rq[q] * rc[c]
            if most + 1e-6 * (1 + abs(most)) < least[q]:
                continue
            if not self.children[q] and not self.children[c]:
                found.append((q, c))
            elif self.children[q] and (not self.children[c] or rq[q] >= rc[c]):
                todo += [(x, c) for x in self.children[q]]
            else:
                todo += [(q, x) for x in self.children[c]]
        return found


def _vectors(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part and their vectors floor(scale * x); shorter ones are filled up with zeros."""
    rows = column.to_pylist()
    ok = [r is not None and all(x is not None for x in r) for r in rows]
    width = max((len(r) for r, k in zip(rows, ok, strict=True) if k), default=0)
    at = np.flatnonzero(ok)
    out = np.zeros((len(at), width))
    for k, i in enumerate(at):
        out[k, : len(rows[i])] = rows[i]
    fine = np.isfinite(out).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(out[fine] * scale)
    return at[fine], np.where(np.isfinite(scaled), scaled, np.floor(out[fine]) * 1.0)


def _top(products: np.ndarray, ids: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per row, the columns of its k largest values, ties to smaller ids; ids ascend."""
    for row in products:
        if len(row) > k:
            kth = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero(row >= kth)
        else:
            at = np.arange(len(row))
        order = np.argsort(row[at], kind="stable")[::-1] if not len(at) else np.lexsort((ids[at], -row[at].astype(np.float64))) if row.dtype == np.float64 else np.array(sorted(range(len(at)), key=lambda j: (-int(row[at[j]]), ids[at[j]])), np.int64)
        yield at[order][:k]


def _whole(rows: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as Python's integers."""
    return np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)


def _long_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products, those beyond 64 bits as the least or largest long."""
    out = _whole(q) @ _whole(c).T
    return np.array([[max(-LONG, min(LONG, int(x))) for x in r] for r in out], np.int64).reshape(len(q), len(c))


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, leaves: int | None = None, block: int | None = None, query_block: int = QUERY_BLOCK, report: dict | None = None) -> DataFrame:
    """Per query the k best other rows: query_id, rank, vec_id, score; ties to the smaller vec_id.

    Components are floor(scale * x). Vectors that are null, or hold null or non-finite components, and rows
    without an id take no part; short vectors count as filled up with zeros. A query's own row is no
    candidate, but another row with its id is. Scores are exact; one beyond 64 bits counts as the least or
    largest long. Other columns, whatever their names, are not read; an empty table gives no rows. report gets
    the number of pairs of leaves, and of those that the bounds leave.
    """
    spark = vectors.sparkSession
    width = vectors.select(F.max(F.size(vector_col)).alias("n")).first()["n"]
    width = max(1, width or 0)
    small = np.sqrt(EXACT / width)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = _vectors(batch.column(2), scale)
            full = np.zeros((len(rows), width))
            full[:, : rows.shape[1]] = rows
            large = np.abs(full).max(axis=1, initial=0) > small
            blobs = pa.array([r.astype("<f8" if x else "<i4").tobytes() for r, x in zip(full, large, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(large), blobs], names=["vec_id", "is_query", "large", "v"])

    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id is not null")
    raw = raw.mapInArrow(parsed, "vec_id long, is_query boolean, large boolean, v binary")
    rows = stored(raw.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_rows = rows.count()
    if leaves is None:
        leaves = min(MAX_LEAVES, max(MIN_LEAVES, n_rows // LEAF_ROWS))
    if block is None:
        block = min(BLOCK, max(256, n_rows // 64))
    picked = rows.where("not large").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").collect()
    tree = CoverTree(np.stack([np.frombuffer(r["v"], "<i4") for r in picked]).astype(np.float64) if picked else np.zeros((0, width)), leaves)
    result = "query_row long, query_id long, vec_id long, score long"
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                large = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                leaf, far = np.full(batch.num_rows, BESIDE), np.zeros(batch.num_rows)
                if not large.all():
                    own = batch.column(3).filter(pa.array(~large)).to_pylist()
                    leaf[~large], far[~large] = tree.file(np.frombuffer(b"".join(own), "<i4").reshape(-1, width).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(leaf, pa.int32()), pa.array(far)], names=["vec_id", "is_query", "v", "row", "leaf", "far"])

    leafed = stored(rows.select("vec_id", "is_query", "large", "v", "row").mapInArrow(filed, "vec_id long, is_query boolean, v binary, row long, leaf int, far double"), "leaves")
    # As many rows as leaves at most.
    about = leafed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count_if("is_query").alias("n_query"), F.max(F.when(F.col("is_query"), F.col("far"))).alias("query_far")).collect()
    sizes = spark.createDataFrame([(r["leaf"], max(1, -(-r["n"] // block)), max(1, -(-r["n_query"] // query_block))) for r in about], "leaf int, cuts int, query_cuts int")
    leafed = leafed.join(sizes, "leaf").withColumn("cut", F.pmod(F.xxhash64("row"), "cuts").cast("int")).withColumn("query_cut", F.pmod(F.xxhash64("row"), "query_cuts").cast("int"))

    def blocked(frame: DataFrame, name: str) -> DataFrame:
        def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["vec_id", "row"])
            blobs = [pdf[c].to_numpy("<i8").tobytes() for c in ("vec_id", "row")]
            return pd.DataFrame({"leaf": [key[0]], "cut": [key[1]], f"{name}_ids": [blobs[0]], f"{name}_rows": [blobs[1]], f"{name}_v": [b"".join(pdf["v"])], f"{name}_far": [float(pdf["far"].max())]})

        return frame.groupBy("leaf", "cut").applyInPandas(gather, f"leaf int, cut int, {name}_ids binary, {name}_rows binary, {name}_v binary, {name}_far double")

    plain = ("leaf", "cut", "vec_id", "row", "v", "far")
    blocks = stored(blocked(leafed.select(*plain), "c"), "blocks")
    asked = leafed.where("is_query").drop("cut").withColumnRenamed("query_cut", "cut")
    queries = stored(blocked(asked.select(*plain), "q"), "queries").withColumnRenamed("leaf", "q_leaf").withColumnRenamed("cut", "q_cut").drop("q_far")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(leaf: int, data: bytes) -> np.ndarray:
            return np.frombuffer(data, "<f8" if leaf == BESIDE else "<i4").reshape(-1, width).astype(np.float64)

        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                q_ids, q_rows, c_ids, c_rows = (np.frombuffer(r[x], "<i8") for x in ("q_ids", "q_rows", "c_ids", "c_rows"))
                q, c = opened(r["q_leaf"], r["q_v"]), opened(r["leaf"], r["c_v"])
                large = BESIDE in (r["q_leaf"], r["leaf"])
                least = np.frombuffer(r["least"], "<f8") if r.get("least") else np.full(len(q), -np.inf)
                if not large:  # of each query by itself: the most that a product with this block can be
                    most = q @ tree.centre[r["leaf"]] + np.linalg.norm(q, axis=1) * r["c_far"]
                    may = most + 1e-6 * (1 + np.abs(most)) >= least
                    q, q_ids, q_rows, least = q[may], q_ids[may], q_rows[may], least[may]
                out: list[tuple] = []
                for at in range(0, len(q), 256):
                    products = _long_products(q[at : at + 256], c) if large else q[at : at + 256] @ c.T
                    own = q_rows[at : at + 256, None] == c_rows[None, :]
                    if large:
                        others = [np.flatnonzero(~x) for x in own]
                        tops = (x[next(_top(p[None, x], c_ids[x], k))] for x, p in zip(others, products, strict=True))
                    else:
                        products[own] = -np.inf
                        tops = _top(products, c_ids, k)
                    for i, top in enumerate(tops, at):
                        score = products[i - at, top]
                        fine = (score >= least[i]) if large else (score >= least[i]) & (score > -np.inf)
                        top = top[fine]
                        out.append((np.full(len(top), q_rows[i]), np.full(len(top), q_ids[i]), c_ids[top], products[i - at, top].astype(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["query_row", "query_id", "vec_id", "score"])

    both = ("q_leaf", "q_ids", "q_rows", "q_v", "leaf", "c_ids", "c_rows", "c_v", "c_far")
    n_in = {r["leaf"]: r["n"] for r in about}
    seeds = [(r["leaf"], x) for r in about if r["n_query"] and r["leaf"] != BESIDE for x in tree.nearest(r["leaf"], n_in, SEEDS)]
    own = queries.join(spark.createDataFrame(seeds, "q_leaf int, leaf int"), "q_leaf").join(blocks.where("cut = 0").drop("cut"), "leaf")
    first = own.select(*both).mapInArrow(multiply, result)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(F.col("query_row").alias("row"), F.col("score").alias("least"))
    least = stored(asked.select("row", "leaf", "cut").join(kth, "row", "left"), "least")
    worst = {r["leaf"]: r["w"] for r in least.groupBy("leaf").agg(F.min(F.coalesce("least", F.lit(-np.inf))).alias("w")).collect()}
    radius = {r["leaf"]: r["far"] for r in about if r["leaf"] != BESIDE}
    query_radius = {r["leaf"]: r["query_far"] for r in about if r["n_query"] and r["leaf"] != BESIDE}
    pairs = tree.pairs(query_radius, worst, radius)
    if report is not None:
        report |= {"pairs": len(query_radius) * len(radius), "kept": len(pairs)}
    if BESIDE in n_in:
        pairs += [(q, BESIDE) for q in query_radius]
        pairs += [(BESIDE, c) for c in n_in if worst.get(BESIDE) is not None]
    if not pairs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def bounds(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        return pd.DataFrame({"q_leaf": [key[0]], "q_cut": [key[1]], "bound_rows": [pdf["row"].to_numpy("<i8").tobytes()], "bounds": [pdf["least"].astype("float64").fillna(-np.inf).to_numpy("<f8").tobytes()]})

    bound = least.groupBy("leaf", "cut").applyInPandas(bounds, "q_leaf int, q_cut int, bound_rows binary, bounds binary")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for q_rows, rows, values in zip(*(batch.column(c).to_pylist() for c in ("q_rows", "bound_rows", "bounds")), strict=True):
                found.append(np.frombuffer(values, "<f8")[np.searchsorted(np.frombuffer(rows, "<i8"), np.frombuffer(q_rows, "<i8"))].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.binary())], names=[*batch.schema.names[:5], "least"])

    bounded = queries.join(bound, ["q_leaf", "q_cut"]).select("q_leaf", "q_cut", "q_ids", "q_rows", "q_v", "bound_rows", "bounds")
    bounded = bounded.mapInArrow(aligned, "q_leaf int, q_cut int, q_ids binary, q_rows binary, q_v binary, least binary")
    wanted = spark.createDataFrame(pairs, "q_leaf int, leaf int")  # at most leaves x leaves rows
    where = F.broadcast(wanted).join(blocks.select("leaf", "cut"), "leaf")
    sent = bounded.join(where, "q_leaf").repartition("leaf", "cut")
    found = sent.join(blocks, ["leaf", "cut"]).select(*both, "least").mapInArrow(multiply, result)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
