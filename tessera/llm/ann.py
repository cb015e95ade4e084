"""Approximate nearest neighbours: an HNSW graph per shard, flat neighbour arrays, merged results.

Vectors are dealt to shards of about SHARD rows by a hash of their id; of large tables, to shards that grow
with the table up to what a task holds. Vectors whose norms differ by more than a factor of 2 ** BAND are in different
shards, as a graph is built over single-precision angles. One task builds a shard's graph: levels are drawn from the id, and each layer is filled in batches that search the layer so
far (and each other) and link both ways under the diversity rule. A layer is a flat
int32 array of neighbour places, padded with -1. Inner products are turned into distances by the
usual extra coordinate that gives all vectors of a shard one length. Equal vectors of a shard are
one node that lists their ids, so copies neither crowd the graph nor get lost.

The index is a table, written to the checkpoint folder. Queries come in blocks of at most BLOCK
rows; every (shard, block) pair is one task, which returns its K best by exact inner products in
double precision, and the K best of all shards are ranked per query.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components take
no part; a vector meets only vectors of its own dimension; of rows that share a vec_id, the one
with the least array counts; ties go to the smaller vec_id; an empty table gives no rows. Components
may be of any finite size: vectors are scaled by powers of two, and only a score itself can be infinite.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

K, SHARD, BLOCK = 20, 6000, 16384
#: Up to SHARDS shards have SHARD rows; beyond, shards grow with the table, to MOST_BYTES of vectors in a task.
SHARDS, MOST_BYTES, BAND = 256, 64 << 20, 8
LINKS, BREADTH, SEARCH, BATCH = 16, 64, 96, 256


class Layer:
    """Nodes (places in the vectors) of one layer and their flat neighbour array of local places."""

    def __init__(self, nodes: np.ndarray, links: np.ndarray) -> None:
        self.nodes, self.links = nodes, links


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: (places, similarities), best first, -1 where there are fewer than ef.

    x: vectors by place; entry: (queries, e) places to start from.
    """
    n, q = len(x), len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(q)[:, None]
    place = np.full((q, ef), n, np.int64)
    near = np.full((q, ef), -np.inf, np.float32)
    done = np.ones((q, ef), bool)
    ext = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    entry = entry[:, :ef]
    place[:, : entry.shape[1]] = np.where(entry < 0, n, entry)
    near[:, : entry.shape[1]] = np.where(entry < 0, -np.inf, np.einsum("qed,qd->qe", ext[entry], queries))
    done[:, : entry.shape[1]] = entry < 0
    seen[rows, place] = True
    active = np.arange(q)
    while len(active):
        open_near = np.where(done[active], -np.inf, near[active])
        at = open_near.argmax(1)
        go = open_near[np.arange(len(active)), at] > -np.inf
        active, at = active[go], at[go]
        if not len(active):
            break
        done[active, at] = True
        new = links[place[active, at]]
        new = np.where(new < 0, n, new)
        old = seen[active[:, None], new]
        seen[active[:, None], new] = True
        sim = np.einsum("qed,qd->qe", ext[new], queries[active])
        sim[old] = -np.inf
        worst = near[active].min(1)
        sim[sim <= worst[:, None]] = -np.inf
        hit = (sim > -np.inf).any(1)
        a = active[hit]
        if len(a):
            p = np.concatenate([place[a], new[hit]], 1)
            s = np.concatenate([near[a], sim[hit]], 1)
            d = np.concatenate([done[a], np.zeros_like(new[hit], bool)], 1)
            top = np.argpartition(-s, ef - 1, 1)[:, :ef]
            place[a], near[a] = np.take_along_axis(p, top, 1), np.take_along_axis(s, top, 1)
            done[a] = np.take_along_axis(d, top, 1) | (near[a] == -np.inf)
    order = np.argsort(-near, 1, kind="stable")
    place, near = np.take_along_axis(place, order, 1), np.take_along_axis(near, order, 1)
    return np.where(near == -np.inf, -1, place), near


def diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates (best first): those nearer to the node than to any chosen before; then the best of the rest."""
    q, c = cand.shape
    vec = x[np.maximum(cand, 0)]
    mutual = np.einsum("qad,qbd->qab", vec, vec)
    picked = np.zeros((q, c), bool)
    count = np.zeros(q, np.int64)
    for j in range(c):
        clash = ((mutual[:, j, :] > sim[:, j, None]) & picked).any(1)
        take = (cand[:, j] >= 0) & (cand[:, j] != own) & ~clash & (count < m)
        picked[:, j] = take
        count += take
    rank = np.where(cand < 0, 2, np.where(cand == own[:, None], 2, np.where(picked, 0, 1)))
    order = np.argsort(rank, 1, kind="stable")[:, :m]
    out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(cand, order, 1), -1)
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def build(x: np.ndarray, keys: np.ndarray, m: int = LINKS, ef: int = BREADTH, batch: int = BATCH) -> list[Layer]:
    """Layers from the bottom up; keys: integers that the levels are drawn from."""
    n = len(x)
    u = (_mix(keys.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    level = np.minimum((-np.log(np.maximum(u, 1e-18)) / math.log(m)).astype(np.int64), 12)
    layers: list[Layer] = []
    above: Layer | None = None
    for at in range(int(level.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(level >= at)
        nodes = nodes[np.lexsort((nodes, -level[nodes]))]
        above = _fill(x, nodes, above, 2 * m if at == 0 else m, ef, batch)
        layers.insert(0, above)
    return layers if n else []


def _fill(x: np.ndarray, nodes: np.ndarray, above: Layer | None, m: int, ef: int, batch: int) -> Layer:
    v = x[nodes]
    links = np.full((len(nodes) + 1, m), -1, np.int32)
    place = {int(p): i for i, p in enumerate(nodes)}
    lift = np.array([place[int(p)] for p in above.nodes]) if above else None
    done = 0
    while done < len(nodes):
        new = np.arange(done, min(len(nodes), done + (batch if done >= batch else max(32, done))))
        q = v[new]
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        cand, sim = np.broadcast_to(new, inner.shape), inner
        if done:
            if above:
                top, _ = beam(x[above.nodes], above.links, q, np.zeros((len(q), 1), np.int64), 4)
                entry = np.where(top < 0, -1, lift[top])
                entry = np.where(entry < done, entry, -1)
                entry = np.concatenate([np.zeros((len(q), 1), np.int64), entry], 1)
                entry[:, 1:][entry[:, 1:] == 0] = -1
            else:
                entry = np.zeros((len(q), 1), np.int64)
            found, near = beam(v[:done], links[: done + 1], q, entry, ef)
            cand, sim = np.concatenate([found, cand], 1), np.concatenate([near, sim], 1)
        order = np.argsort(-sim, 1, kind="stable")[:, :ef]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        cand = np.where(sim == -np.inf, -1, cand)
        chosen = diverse(v, new, cand, sim, m // 2 if m > LINKS else m)
        links[new, : chosen.shape[1]] = chosen
        src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
        ok = dst >= 0
        _link_back(v, links, src[ok], dst[ok], m)
        done = int(new[-1]) + 1
        if done < len(nodes):
            links[done] = -1
    return Layer(nodes.astype(np.int32), links)


def _link_back(v: np.ndarray, links: np.ndarray, src: np.ndarray, dst: np.ndarray, m: int) -> None:
    """Adds src to the neighbours of dst; full lists are chosen anew among old and new."""
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    hub, first, count = np.unique(dst, return_index=True, return_counts=True)
    for start in range(0, len(hub), 256):
        h, f, c = hub[start : start + 256], first[start : start + 256], count[start : start + 256]
        wide = min(int(c.max()), 4 * m)
        extra = np.full((len(h), wide), -1, np.int64)
        for j in range(wide):
            has = c > j
            extra[has, j] = src[f[has] + j]
        both = np.concatenate([links[h].astype(np.int64), extra], 1)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        sim = np.where(both < 0, -np.inf, np.einsum("qed,qd->qe", v[np.maximum(both, 0)], v[h])).astype(np.float32)
        order = np.argsort(-sim, 1, kind="stable")
        both, sim = np.take_along_axis(both, order, 1), np.take_along_axis(sim, order, 1)
        full = (both >= 0).sum(1) > m
        links[h[~full]] = both[~full, :m]
        if full.any():
            links[h[full]] = diverse(v, h[full], both[full], sim[full], m)


def search(x: np.ndarray, layers: list[Layer], queries: np.ndarray, ef: int = SEARCH) -> np.ndarray:
    """Places found for each query, nearest first, -1 where there are fewer than ef."""
    entry = np.zeros((len(queries), 1), np.int64)
    for up in layers[:0:-1]:
        got, _ = beam(x[up.nodes], up.links, queries, entry, 4)
        entry = np.where(got < 0, -1, up.nodes[got])
        below = layers[layers.index(up) - 1]
        back = np.full(len(x) + 1, -1, np.int64)
        back[below.nodes] = np.arange(len(below.nodes))
        entry = np.where(entry < 0, -1, back[entry])
        entry[:, 0] = np.where(entry[:, 0] < 0, 0, entry[:, 0])
    base = layers[0]
    got, _ = beam(x[base.nodes], base.links, queries, entry, ef)
    return np.where(got < 0, -1, base.nodes[got])


def _mix(a: np.ndarray) -> np.ndarray:
    from .common import mix

    return mix(a + np.uint64(0x9E3779B97F4A7C15))


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by powers of two, exactly, so that their largest components lie in [0.5, 1); and the powers."""
    power = np.frexp(np.abs(v).max(1))[1].astype(np.int64)
    half = power // 2  # in two steps, as 2 ** -power may not be a double
    return np.ldexp(np.ldexp(v, -half[:, None]), -(power - half)[:, None]), power


def lifted(v: np.ndarray) -> np.ndarray:
    """v with one more coordinate, all of one length: nearest by angle is then largest by inner product."""
    unit, power = scaled(v)
    v = np.ldexp(unit, (power - power.max(initial=0) if len(power) else power)[:, None])
    sq = (v.astype(np.float64) ** 2).sum(1)
    top = sq.max(initial=0.0) or 1.0
    return (np.concatenate([v, np.sqrt(np.maximum(top - sq, 0))[:, None]], 1) / math.sqrt(top)).astype(np.float32)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, dim, band) of the rows that take part, the least array of each id; band: norms within a factor of 2 ** BAND."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).dropna()
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    most = F.array_max(F.transform("v", F.abs))
    return rows.withColumn("dim", F.size("v")).withColumn("band", F.floor(F.log2(most) / BAND).cast("int"))


def shards_for(rows: int, dim: int, shard_rows: int = SHARD) -> int:
    """Shards of a band: of shard_rows rows up to SHARDS of them, then larger ones up to MOST_BYTES each."""
    return max(1, math.ceil(rows / max(shard_rows, min(math.ceil(rows / SHARDS), MOST_BYTES // (8 * dim)))))


def build_index(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """The index table: one row a shard (dim, band, shard, ids, vectors, nodes and links of each layer, as flat arrays)."""
    sizes = vectors.groupBy("dim", "band").agg(F.count("*").alias("n")).collect()  # bands are at most 2200 / BAND a dimension
    most = F.lit(1)
    for r in sizes:
        if (n := shards_for(r["n"], r["dim"], shard_rows)) > 1:
            most = F.when((F.col("dim") == r["dim"]) & (F.col("band") == r["band"]), n).otherwise(most)
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), most).cast("int"))

    def make(g: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(g["v"].to_numpy())
        ids = g["vec_id"].to_numpy()
        raw = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel()
        order = np.argsort(ids, kind="stable")
        ids, v, raw = ids[order], v[order], raw[order]
        _, first, node = np.unique(raw, return_index=True, return_inverse=True)
        again = np.argsort(first)
        rank = np.empty_like(again)
        rank[again] = np.arange(len(again))
        node, x = rank[node].astype(np.int32), lifted(v[np.sort(first)])
        layers = build(x, ids[np.sort(first)])
        return pd.DataFrame({"dim": [v.shape[1]], "band": [g["band"].iloc[0]], "shard": [g["shard"].iloc[0]], "ids": [ids.tobytes()], "vectors": [v.tobytes()], "node_of": [node.tobytes()], "nodes": [[a.nodes.tobytes() for a in layers]], "links": [[a.links.tobytes() for a in layers]], "width": [[a.links.shape[1] for a in layers]]})

    return settled(dealt.groupBy("dim", "band", "shard").applyInPandas(make, "dim int, band int, shard int, ids binary, vectors binary, node_of binary, nodes array<binary>, links array<binary>, width array<int>"))


def search_index(index: DataFrame, queries: DataFrame, k: int = K, ef: int = SEARCH, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products among all rows but those of its own id."""
    blocks = max(1, math.ceil(queries.count() / block_rows))
    every = index.select(F.col("dim").alias("_dim"), F.col("band").alias("_band"), F.col("shard").alias("_shard"))
    asked = queries.select("dim", F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.join(F.broadcast(every), F.col("dim") == F.col("_dim")).select("dim", F.col("_band").alias("band"), F.col("_shard").alias("shard"), "block", "query_id", "v")  # a row a shard
    offered = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        s = left.iloc[0]
        ids = np.frombuffer(s["ids"], np.int64)
        v = np.frombuffer(s["vectors"]).reshape(len(ids), -1)
        node = np.frombuffer(s["node_of"], np.int32)
        layers = [Layer(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32).reshape(-1, w)) for a, b, w in zip(s["nodes"], s["links"], s["width"], strict=True)]
        v, power = scaled(v)
        q, high = scaled(np.stack(right["v"].to_numpy()))
        qid = right["query_id"].to_numpy()
        order = np.argsort(node, kind="stable")
        first = np.searchsorted(node[order], np.arange(int(node.max()) + 2))
        rep = order[first[:-1]]
        x = lifted(np.ldexp(v[rep], (power[rep] - power.max())[:, None]))
        norm = np.linalg.norm(q, axis=1)
        unit = np.concatenate([q / norm[:, None], np.zeros((len(q), 1))], 1).astype(np.float32)
        out = []
        for a in range(0, len(q), 512):
            found = search(x, layers, unit[a : a + 512], max(ef, k + 1))
            for i, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                # k + 1 copies of a node are enough: the least ids come first
                rows = np.concatenate([order[first[m] : min(first[m + 1], first[m] + k + 1)] for m in nodes])
                rows = rows[ids[rows] != qid[a + i]]
                with np.errstate(over="ignore"):
                    score = np.ldexp((v[rows] * q[a + i]).sum(1), power[rows] + high[a + i])
                best = np.lexsort((ids[rows], -score))[:k]
                out.append(pd.DataFrame({"query_id": qid[a + i], "vec_id": ids[rows[best]], "score": score[best]}))
        return pd.concat(out)

    pairs = offered.groupBy("dim", "band", "shard", "block").cogroup(asked.groupBy("dim", "band", "shard", "block")).applyInPandas(look, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """Each row whose id is divisible by every, against all rows."""
    rows = usable(df, id_col, vec_col)
    rows = settled(rows)
    return search_index(build_index(rows), rows.filter(F.col("vec_id") % every == 0), k)
