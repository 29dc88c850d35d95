"""Approximate nearest neighbours: robust-pruned directed graphs per shard, searched by beam."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import key_of, materialize, maybe_broadcast


class PrunedGraph:
    """A directed graph over vectors: greedy searches propose neighbours, relaxed pruning keeps diverse ones.

    All steps work on many vectors at a time. Distances are squared Euclidean ones.
    """

    def __init__(self, x: np.ndarray, degree: int, beam: int, alpha: float, seed: int = 0):
        self.x, self.degree, self.beam, self.alpha = np.ascontiguousarray(x, np.float32), degree, beam, alpha**2
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        self.start = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin())
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        done = 1
        while done < n:  # batches double in size, so each meets a graph of at least its own size
            batch = order[done : done + min(done, 2048)]
            self._insert(batch)
            done += len(batch)

    def search(self, queries: np.ndarray, beam: int, pool: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest vectors found for each query, nearest first: (indexes, distances); -1 where fewer.
        With `pool`, all whose distance was ever the best unvisited one, for pruning."""
        m, n = len(queries), len(self.x)
        ids = np.full((m, beam), -1, np.int32)
        dist = np.full((m, beam), np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        ids[:, 0], open_[:, 0] = self.start, True
        dist[:, 0] = ((queries - self.x[self.start]) ** 2).sum(1)
        seen = np.zeros((m, n), bool)
        seen[:, self.start] = True
        live = np.arange(m)
        visited_i, visited_d, visited_q = [], [], []
        while len(live):
            at = open_[live].argmax(1)
            node, d = ids[live, at], dist[live, at]
            open_[live, at] = False
            if pool:
                visited_q.append(live)
                visited_i.append(node)
                visited_d.append(d)
            near = self.edges[node]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            rows, _ = np.nonzero(fresh)
            flat = near[fresh]
            seen[live[rows], flat] = True
            diff = self.x[flat] - queries[live[rows]]
            new = np.full(near.shape, np.inf, np.float32)
            new[fresh] = np.einsum("ij,ij->i", diff, diff)
            both_d = np.concatenate([dist[live], new], 1)
            order = np.argsort(both_d, 1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(both_d, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], 1), order, 1) & np.isfinite(dist[live])
            live = live[open_[live].any(1)]
        ids[~np.isfinite(dist)] = -1
        if not pool:
            return ids, dist
        q, i, d = (np.concatenate(v) for v in (visited_q, visited_i, visited_d))
        return _padded(np.concatenate([q, np.repeat(np.arange(m), beam)]), np.concatenate([i, ids.ravel()]), np.concatenate([d, dist.ravel()]), m)

    def _prune(self, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Of each row's candidates (nearest first, -1 for none) up to `degree`: each kept one removes those that are
        nearer to it, relaxed by alpha, than to the row's own vector."""
        m, c = ids.shape
        out = np.full((m, self.degree), -1, np.int32)
        alive = ids >= 0
        vectors = self.x[np.maximum(ids, 0)]
        norms = np.einsum("mcd,mcd->mc", vectors, vectors)
        rows = np.arange(m)
        for k in range(self.degree):
            some = alive.any(1)
            if not some.any():
                break
            at = alive.argmax(1)
            out[some, k] = ids[rows, at][some]
            pick = vectors[rows, at]
            between = norms + norms[rows, at][:, None] - 2 * np.einsum("mcd,md->mc", vectors, pick)
            alive &= self.alpha * np.maximum(between, 0) > dist
            alive[rows, at] = False
        return out

    def _insert(self, batch: np.ndarray) -> None:
        for part in np.array_split(batch, max(1, len(batch) // 512)):
            ids, dist = self.search(self.x[part], self.beam, pool=True)
            self.edges[part] = self._prune(ids, dist)
        # the way back, where each neighbour may have to prune in its turn
        to = self.edges[batch]
        source = np.repeat(batch, self.degree)[to.ravel() >= 0].astype(np.int32)
        target = to.ravel()[to.ravel() >= 0]
        touched, row = np.unique(target, return_inverse=True)
        old = self.edges[touched]
        row = np.concatenate([row, np.repeat(np.arange(len(touched)), self.degree)])
        who = np.concatenate([source, old.ravel()])
        row, who = row[who >= 0], who[who >= 0]
        diff = self.x[who] - self.x[touched[row]]
        ids, dist = _padded(row, who, np.einsum("ij,ij->i", diff, diff), len(touched))
        for a in range(0, len(touched), 512):
            self.edges[touched[a : a + 512]] = self._prune(ids[a : a + 512], dist[a : a + 512])


def _padded(row: np.ndarray, ids: np.ndarray, dist: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Ragged (row, id, distance) to matrices sorted by distance, without repeats; -1 and inf fill up."""
    order = np.lexsort((ids, row))
    row, ids, dist = row[order], ids[order], dist[order]
    keep = (ids >= 0) & np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))
    row, ids, dist = row[keep], ids[keep], dist[keep]
    order = np.lexsort((dist, row))
    row, ids, dist = row[order], ids[order], dist[order]
    first = np.searchsorted(row, np.arange(m))
    column = np.arange(len(row)) - first[row]
    width = int(column.max(initial=0)) + 1
    out_i, out_d = np.full((m, width), -1, np.int32), np.full((m, width), np.inf, np.float32)
    out_i[row, column], out_d[row, column] = ids, dist
    return out_i, out_d


class Shard:
    """A graph over a shard's distinct vectors; each stands for the ids that have it, the `k` + 1 least of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, degree: int, beam: int, alpha: float):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.append(True, (x[1:] != x[:-1]).any(1))
        first = np.flatnonzero(new)
        self.members = [ids[a : min(b, a + k + 1)] for a, b in zip(first, np.append(first[1:], len(ids)))]
        self.k, self.beam = k, max(beam, k + 1)
        self.plain = len(first) == len(ids)
        self.ids = ids
        self.graph = PrunedGraph(x[first], degree, self.beam, alpha)

    def nearest(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, neighbour, squared distance), at most k for each query, itself left out."""
        rows, who, dist = [], [], []
        step = max(64, min(2048, (32 << 20) // len(self.graph.x)))
        for a in range(0, len(x), step):
            found, d = self.graph.search(x[a : a + step], self.beam)
            if self.plain:
                r, c = np.nonzero(found >= 0)
                w, v = self.ids[found[r, c]], d[r, c]
            else:
                r, w, v = [], [], []
                for row, (f, e) in enumerate(zip(found.tolist(), d.tolist())):
                    n, last = 0, 0.0
                    for i, y in zip(f, e):
                        if i < 0 or n > self.k and y > last:  # equally distant ones compete by id
                            break
                        last = y
                        m = self.members[i]
                        n += len(m)
                        r += [row] * len(m)
                        w += m.tolist()
                        v += [y] * len(m)
                r, w, v = np.array(r, np.int64), np.array(w, np.int64), np.array(v, np.float32)
            ok = w != ids[a + r]
            r, w, v = r[ok], w[ok], v[ok]
            order = np.lexsort((w, v, r))
            r, w, v = r[order], w[order], v[order]
            ok = np.arange(len(r)) - np.searchsorted(r, r) < self.k
            rows.append(a + r[ok])
            who.append(w[ok])
            dist.append(v[ok])
        return np.concatenate(rows), np.concatenate(who), np.concatenate(dist)


def _search(k: int, degree: int, beam: int, alpha: float):
    """Rows sorted by (cell, kind): a shard's vectors come first, then the queries, which stream past its graph."""

    def run(it):
        at, shard = None, None
        ids: list[np.ndarray] = []
        xs: list[np.ndarray] = []
        for batch in it:
            cell, kind, who = (batch.column(c).to_numpy() for c in (0, 1, 2))
            edges = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1]))) if len(cell) else []
            for a, b in zip(edges, np.append(edges[1:], len(cell))):
                flat = batch.column(3).slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                x = flat.astype(np.float32, copy=False).reshape(b - a, -1)  # a cell's vectors are of one length
                if cell[a] != at:
                    at, shard, ids, xs = cell[a], None, [], []
                if kind[a] == 0:
                    ids.append(who[a:b])
                    xs.append(x)
                    continue
                if shard is None:
                    if not ids:
                        continue
                    shard = Shard(np.concatenate(ids), np.concatenate(xs), k, degree, beam, alpha)
                    ids, xs = [], []
                r, w, d = shard.nearest(who[a:b], x)
                size = np.bincount(r, minlength=b - a)
                lists = pa.ListArray.from_arrays(
                    np.append(0, np.cumsum(size)).astype(np.int32), pa.StructArray.from_arrays([pa.array(d.astype(np.float64)), pa.array(w.astype(np.int64))], ["d", "w"]))
                yield pa.RecordBatch.from_arrays([pa.array(who[a:b]), lists], ["vec_id", "found"])

    return run


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
    shard_rows: int = 16384, degree: int = 24, beam: int = 40, alpha: float = 1.2,
) -> DataFrame:
    """The k approximate nearest others, by Euclidean distance, of every vector of `queries` (of `vectors`, if not given).

    Result: (vec_id, rank, neighbour_id, distance); rank 1 is nearest, ties by id. All vectors are indexed: they are
    spread by hash of the id over shards of about `shard_rows`, every shard has its own graph, each query goes to all
    shards for its length, and the shards' answers are merged, so work grows with queries times shards. Queries are
    told from their equals by id: a neighbour with the query's id is left out. Vectors meet only vectors of their own
    length. Left out, as query and as neighbour: null ids, null or empty vectors and those with a null, NaN or infinite
    part. Rows with one id count once, with the least vector. Equal vectors share a node, so copies never crowd out
    other neighbours of the graph. Fewer than k others give fewer rows; an empty table gives none. Ids that aren't
    integers are ordered by a 64-bit hash.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame, name: str) -> DataFrame:
        v = F.col(f"`{vector_col}`").cast("array<float>")
        rows = df.select(key_of(id_col, df).alias("id"), F.col(f"`{id_col}`").alias("name"), v.alias("v")).where(F.col("id").isNotNull()).where(
            F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)) & (F.size("v") > 0))
        return materialize(rows.groupBy("id").agg(F.min("v").alias("v"), F.min("name").alias("name")), name)[0]

    known = clean(vectors, "vectors")
    asking = known if queries is None else clean(queries, "queries")
    # one row a vector length: its number of shards, and the number of its first one
    counts = known.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int"))
    before = F.sum("shards").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1))
    dims, _ = materialize(counts.select("dim", "shards", F.coalesce(before, F.lit(0)).cast("int").alias("base")), "dims")
    total = dims.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    dims = maybe_broadcast(dims, 16)
    own = known.join(dims, F.size("v") == F.col("dim")).select((F.col("base") + F.pmod(F.xxhash64("id"), F.col("shards"))).cast("int").alias("cell"), F.lit(0).alias("kind"), "id", "v")
    asked = asking.join(dims, F.size("v") == F.col("dim")).select(
        F.explode(F.sequence(F.col("base"), F.col("base") + F.col("shards") - 1)).alias("cell"), F.lit(1).alias("kind"), "id", "v")
    rows = own.unionByName(asked).repartitionById(max(1, total), "cell").sortWithinPartitions("cell", "kind", "id")
    answers = rows.mapInArrow(_search(k, degree, beam, alpha), "vec_id long, found array<struct<d double, w long>>")
    best = answers.groupBy("vec_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("best"))
    best = best.select("vec_id", F.posexplode("best").alias("at", "n")).select(
        "vec_id", (F.col("at") + 1).alias("rank"), F.col("n.w").alias("neighbour_id"), F.round(F.sqrt("n.d"), 6).alias("distance"))
    if isinstance(vectors.schema[id_col].dataType, IntegralType):
        return best
    to = known.select(F.col("id").alias("neighbour_id"), F.col("name").alias("b"))
    of = asking.select(F.col("id").alias("vec_id"), F.col("name").alias("a"))
    return best.join(to, "neighbour_id").join(of, "vec_id").select(F.col("a").alias("vec_id"), "rank", F.col("b").alias("neighbour_id"), "distance")
