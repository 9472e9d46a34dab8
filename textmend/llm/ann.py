"""Nearest neighbours by inner product: anisotropic quantisation, table scans, exact rerank.

A vector is a coarse cell's centre plus a product code: ``DIMS`` dimensions a
subspace, 16 centroids (four bits) each.  Codes and codebooks minimise the score-aware
loss |r|^2 + (eta - 1) (r . x/|x|)^2 of the error r: error along the vector itself, which
moves its large inner products, costs eta times as much as error across it.  A query
adds up table entries of the codes in the cells it probes; of each block the best
``RERANK``, and all within ``MARGIN`` deviations of the codes' error of the k-th best, are scored again in double precision on the original vectors.

Codebooks and centres are fitted on a bounded sample (about ``FIT`` vectors, below a threshold of their hash).
Every vector is coded and indexed.  The number of cells follows the square root of the
number of vectors; a cell with more than ``BLOCK`` vectors is cut into blocks by hash, its
queries into blocks as well, so one task's group is bounded however hot a cell is.  A
query probes ``PROBE`` of all cells by its product with their centres, and more until
``LEAST`` times k vectors are in them.  The default share is high because vectors spread
evenly over a sphere have neighbours in most cells; clustered vectors need far less.

Edge cases: vectors that are null, empty, zero, of another length than most of the
sample, or hold null or non-finite parts take no part; fewer candidates than k: all
are returned; equal scores go by vec_id; rows of one id are all candidates but never
their own query's; null ids are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, ship, stage, table

K, DIMS, FIT, BLOCK, RERANK, PROBE, LEAST, ETA, MARGIN = 20, 2, 8192, 4096, 48, 0.95, 20, 3.0, 1.5


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096] @ c.T - half).argmax(1)
    return out


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Cell centres and four-bit codebooks of a sample."""

    def __init__(self, sample: np.ndarray, cells: int, dims: int = DIMS, eta: float = ETA, seed: int = 5, rounds: int = 4):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        self.d, self.dims, self.eta, self.m = d, dims, eta, -(-d // dims)
        self.centres = kmeans(sample, cells, rng)
        r, u = self._split(sample, self.centres[_nearest(sample, self.centres)])
        self.books = np.stack([kmeans(r[:, j], 16, rng) for j in range(self.m)])
        for _ in range(rounds):
            code, err = self._assign(r, u)
            along = (err * u).sum(2)
            total = along.sum(1)
            for j in range(self.m):
                # Least squares of each centroid under the loss, the other subspaces held.
                others = total - along[:, j]
                target = others + (r[:, j] * u[:, j]).sum(1)
                for c in range(16):
                    at = code[:, j] == c
                    if at.any():
                        uu = u[at, j]
                        lhs = at.sum() * np.eye(dims) + (eta - 1) * uu.T @ uu
                        self.books[j, c] = np.linalg.solve(lhs, r[at, j].sum(0) + (eta - 1) * (uu * target[at, None]).sum(0))
                err[:, j] = r[:, j] - self.books[j][code[:, j]]
                along[:, j] = (err[:, j] * u[:, j]).sum(1)
                total = others + along[:, j]

        cell, codes = self.encode(sample)
        q = sample[rng.choice(n, min(n, 128), replace=False)]
        t = self.tables(q)
        rough = (q @ self.centres.T)[:, cell] + sum(t[:, b][:, codes[:, b]] for b in range(codes.shape[1]))
        self.sigma = float(np.sqrt(np.mean((rough - q @ sample.T) ** 2)))

    def _split(self, x, centre):
        pad = ((0, 0), (0, self.m * self.dims - self.d))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return (np.pad(v, pad).reshape(len(x), self.m, self.dims) for v in (x - centre, unit))

    def _assign(self, r, u, passes: int = 2):
        """Codes by coordinate descent on the loss, from the nearest centroids."""
        code = np.stack([_nearest(r[:, j], self.books[j]) for j in range(self.m)], 1)
        err = np.stack([r[:, j] - self.books[j][code[:, j]] for j in range(self.m)], 1)
        along = (err * u).sum(2)
        total = along.sum(1)
        for _ in range(passes):
            for j in range(self.m):
                others = total - along[:, j]
                e = r[:, j, None] - self.books[j]  # n x 16 x dims
                a = np.einsum("nkd,nd->nk", e, u[:, j])
                best = ((e * e).sum(2) + (self.eta - 1) * (others[:, None] + a) ** 2).argmin(1)
                code[:, j], rows = best, np.arange(len(r))
                err[:, j], along[:, j] = e[rows, best], a[rows, best]
                total = others + along[:, j]
        return code, err

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes packed two to a byte)."""
        cell = _nearest(x, self.centres)
        code = np.concatenate([self._assign(*self._split(x[i : i + 2048], self.centres[cell[i : i + 2048]]))[0] for i in range(0, len(x), 2048)])
        if self.m % 2:
            code = np.pad(code, ((0, 0), (0, 1)))
        return cell, (code[:, ::2] | code[:, 1::2] << 4).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Per query and byte of code, the inner products of its two centroids: n x bytes x 256."""
        pad = np.pad(q, ((0, 0), (0, self.m * self.dims - self.d))).reshape(len(q), self.m, self.dims)
        t = np.einsum("nmd,mkd->nmk", pad, self.books)
        if self.m % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, ::2, None, :] + t[:, 1::2, :, None]).reshape(len(q), t.shape[1] // 2, 256).astype(np.float32)


def scan(quant: Quantiser, cell: int, q: np.ndarray, codes: np.ndarray, x: np.ndarray, qid, xid, k: int, rerank: int):
    """(query, vector, exact score) of the best k in a block for each query; ``xid`` ascending."""
    out = []
    for i in range(0, len(q), 64):
        part = q[i : i + 64]
        t = quant.tables(part)
        rough = np.repeat((part @ quant.centres[cell]).astype(np.float32)[:, None], len(codes), 1)
        for b in range(codes.shape[1]):
            rough += t[:, b][:, codes[:, b]]
        n = rough.shape[1]
        if n > max(rerank, k + 1):
            # All that may belong to the best k, as far as codes tell: those within the codes'
            # error of the k-th best (a tight cluster is kept whole), and ``rerank`` at least.
            part_ = np.partition(rough, (n - rerank, n - k - 1), axis=1)
            edge = np.minimum(part_[:, n - rerank], part_[:, n - k - 1] - np.float32(MARGIN * quant.sigma))
            keep = rough >= edge[:, None]
        else:
            keep = np.ones(rough.shape, bool)
        keep &= xid[None, :] != qid[i : i + 64, None]
        row, at = np.nonzero(keep)
        exact = (x[at] * part[row]).sum(1)
        order = np.lexsort((xid[at], -exact, row))
        row, at, exact = row[order], at[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < k
        out.append((qid[i : i + 64][row[top]], xid[at[top]], exact[top]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]


def _matrix(col, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def search(vectors: DataFrame, queries: DataFrame, *, id_col="vec_id", vec_col="embedding", k=K, fit=FIT, block=BLOCK, rerank=RERANK, probe=PROBE, eta=ETA, cells: int | None = None) -> DataFrame:
    """(query_id, rank, id, score) of the nearest vectors of every query row."""
    spark = vectors.sparkSession
    ship(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fine = F.col("id").isNotNull() & F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(fine)
    every, asked = clean(vectors), clean(queries)
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    n = every.count()
    # A sample by a threshold of the hash: about ``fit`` rows, however many partitions there are.
    picked = every if n <= fit else every.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(fit / n * (1 << 30)))
    got = picked.toPandas().sort_values("id", kind="stable")
    if not len(got):
        return empty
    sizes = got.v.map(len)
    d = int(sizes.mode().iloc[0])
    sample = np.stack(got.v[sizes == d].to_numpy()).astype(np.float64)
    every, asked = every.filter(F.size("v") == d), asked.filter(F.size("v") == d)
    every_n = every.count()
    cells = cells or max(1, round(math.sqrt(every_n) / 4))
    quant = Quantiser(sample, min(cells, len(sample)), eta=eta)
    cells = len(quant.centres)
    coder = spark.sparkContext.broadcast(quant)  # bounded: the cells' centres and 16 centroids a subspace

    def code(batches):
        for b in batches:
            if b.num_rows:
                cell, codes = coder.value.encode(_matrix(b.column(1), d))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "cell", "code"])

    coded = stage(arrow_map(every, code, "id long, v array<double>, cell int, code binary"), "codes")
    count = np.zeros(cells, np.int64)
    for c, m in coded.groupBy("cell").count().collect():
        count[c] = m  # one row per cell
    blocks = np.maximum(1, -(-count // block))
    want, least = max(1, math.ceil(probe * cells)), LEAST * k

    def aim(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-(_matrix(b.column(1), d) @ coder.value.centres.T), axis=1, kind="stable")
            have = np.cumsum(count[order], axis=1)
            need = np.maximum(want, np.minimum((have < least).sum(1) + 1, cells))
            at = np.repeat(np.arange(len(need)), need)
            cell = np.concatenate([o[:m] for o, m in zip(order, need)])
            times = blocks[cell]
            at, cell = np.repeat(at, times), np.repeat(cell, times)
            blk = np.concatenate([np.arange(t) for t in times])
            part = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(blk, pa.int32())], names=["id", "v", "cell", "blk"])

    aimed = stage(arrow_map(asked, aim, "id long, v array<double>, cell int, blk int"), "aimed")
    # Queries of a cell are dealt into blocks too; vectors meet each of them.
    load = aimed.filter("blk = 0").groupBy("cell").count().withColumn("qn", F.ceil(F.col("count") / block).cast("int"))
    load = {r.cell: r.qn for r in load.collect()}
    per = F.create_map(*[F.lit(x) for c in range(cells) for x in (c, load.get(c, 0))])
    nb = F.create_map(*[F.lit(x) for c in range(cells) for x in (c, int(blocks[c]))])
    left = coded.withColumn("blk", F.pmod(F.xxhash64("id"), nb[F.col("cell")]).cast("int"))
    left = left.withColumn("qb", F.explode(F.sequence(F.lit(0), F.greatest(per[F.col("cell")] - 1, F.lit(0)))))
    right = aimed.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(per[F.col("cell")], F.lit(1))).cast("int"))

    def near(key, x, q):
        if not x.num_rows or not q.num_rows:
            a, b, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            x = x.sort_by("id").combine_chunks()
            codes = np.frombuffer(b"".join(x.column("code").to_pylist()), np.uint8).reshape(x.num_rows, -1)
            a, b, s = scan(coder.value, key[0].as_py(), _matrix(q.column("v").combine_chunks(), d), codes, _matrix(x.column("v").combine_chunks(), d), q.column("id").to_numpy(), x.column("id").to_numpy(), k, rerank)
        return pa.table({"query_id": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["cell", "blk", "qb"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(near, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op7_nearest(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0))
