"""Embedding near-duplicates over one robust-pruned flat graph, built on overlapping cluster shards.

Vectors are dealt to the shards of their two nearest centroids; every shard builds a robust-pruned neighbour
graph, and a vector's adjacency lists from its shards are united. A shard is searched with the nodes of other
shards that the united lists of its members lead to by links short enough for a query to have both ends in reach. A query enters the shards nearest to it, each
by a range-expanding greedy search from medoids; where that meets a node within reach that is at home in a
shard not yet entered, the query is carried there, round by round until no border is left to cross. Found links
are verified by cosine in double precision. Recall is then audited by brute force on a bounded sample.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.graph import components
from lexmill.session import durable


@dataclass(frozen=True)
class GraphParams:
    threshold: float = 0.93
    #: Vectors that centroids are fitted on at most, chosen by hash; all vectors are indexed.
    max_fit_rows: int = 20_000
    #: Vectors a centroid stands for. Where a first-level cluster would hold more than ``shard_rows``, it is
    #: split by centroids of its own, so shards stay this small however many vectors there are.
    per_cluster: int = 800
    shard_rows: int = 2000
    #: A query enters shards whose centroid's cosine is this close to the best one's; others it is carried to.
    margin: float = 0.08
    degree: int = 16
    alpha: float = 1.2
    #: Best nodes kept while searching, and how many of them are expanded at a time.
    beam: int = 32
    width: int = 6
    entries: int = 8
    #: Nodes this far below the threshold count as within reach: they are expanded and cross borders.
    slack: float = 0.05
    #: Vectors whose links brute force counts, and the share of these that must be found.
    audit_rows: int = 200
    least_recall: float = 0.9
    seed: int = 5


def unit(v) -> np.ndarray | None:
    """The vector over its length; None for null, empty, zero, or null or non-finite components."""
    if v is None or len(v) == 0:
        return None
    x = np.array([np.nan if c is None else c for c in v], np.float64) if getattr(v, "dtype", None) == object or not isinstance(v, np.ndarray) else v.astype(np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def centroids(sample: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def medoids(x: np.ndarray, k: int) -> np.ndarray:
    """The vector nearest the mean, then the farthest from those held so far."""
    out = [int((x @ x.mean(0)).argmax())]
    best = x @ x[out[0]]
    while len(out) < min(k, len(x)):
        out.append(int(best.argmin()))
        best = np.maximum(best, x @ x[out[-1]])
    return np.array(out)


def greedy_search(q: np.ndarray, x: np.ndarray, adj: np.ndarray, start: np.ndarray, params: GraphParams, reach: float | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(query, nodes seen, their cosines)`` for each row of q, over the graph of rows of x.

    ``adj`` holds each node's neighbours, filled up with -1. The best unexpanded nodes of a beam are expanded
    until none is left; with ``reach``, so is every node of at least that cosine, whatever its rank.
    """
    m = len(x)
    for lo in range(0, len(q), 512):
        block = q[lo : lo + 512]
        n, rows = len(block), np.arange(len(block))[:, None]
        seen = np.zeros((n, m + 1), bool)
        seen[:, m] = True  # where -1 points
        seen[:, start] = True
        ids = np.broadcast_to(start, (n, len(start)))
        sims = block @ x[start].T
        log = [(np.repeat(rows.ravel(), len(start)), ids.ravel(), sims.ravel())]
        fresh = np.ones(ids.shape, bool)  # not yet expanded
        while True:
            rank = np.argsort(-np.where(fresh, sims, -3), axis=1, kind="stable")
            pick = rank[:, : params.width]
            floor = np.partition(sims, sims.shape[1] - params.beam, axis=1)[:, -params.beam] if sims.shape[1] > params.beam else np.full(n, -2.0)
            least = floor if reach is None else np.minimum(floor, reach)
            go = np.take_along_axis(fresh, pick, 1) & (np.take_along_axis(sims, pick, 1) >= least[:, None])
            if not go.any():
                break
            a, c = np.nonzero(go)
            fresh[a, pick[a, c]] = False
            near = adj[ids[a, pick[a, c]]]
            qi, xi = np.repeat(a, near.shape[1]), near.ravel()
            new = ~seen[qi, xi]
            code = np.unique(qi[new] * (m + 1) + xi[new])
            qi, xi = code // (m + 1), code % (m + 1)
            seen[qi, xi] = True
            s = np.einsum("ij,ij->i", block[qi], x[xi]) if len(qi) else np.empty(0, x.dtype)
            log.append((qi, xi, s))
            # append the new nodes to the queries' lists, then cut each list to what may still be expanded
            count = np.bincount(qi, minlength=n)
            wide = int(count.max(initial=0))
            add_id, add_sim, add_new = np.zeros((n, wide), int), np.full((n, wide), -3, sims.dtype), np.zeros((n, wide), bool)
            place = np.arange(len(qi)) - np.repeat(np.cumsum(count) - count, count)
            add_id[qi, place], add_sim[qi, place], add_new[qi, place] = xi, s, True
            ids, sims, fresh = np.concatenate([ids, add_id], 1), np.concatenate([sims, add_sim], 1), np.concatenate([fresh, add_new], 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims, fresh = (np.take_along_axis(v, order, 1) for v in (ids, sims, fresh))
            need = params.beam
            if reach is not None:
                need = max(need, int(((sims >= reach) & fresh).any(0).nonzero()[0].max(initial=-1)) + 1)
            ids, sims, fresh = ids[:, :need], sims[:, :need], fresh[:, :need]
        qi, xi, s = (np.concatenate(v) for v in zip(*log))
        order = np.argsort(qi, kind="stable")
        edge = np.searchsorted(qi[order], np.arange(n + 1))
        for i in range(n):
            own = order[edge[i] : edge[i + 1]]
            yield lo + i, xi[own], s[own]


def _prune(node: np.ndarray, cand: np.ndarray, sim: np.ndarray, x: np.ndarray, params: GraphParams) -> np.ndarray:
    """Rows of at most ``degree`` neighbours of each node, of candidates with their cosines (-3: none).

    The nearest left is kept, and candidates that are ``alpha`` times closer to it than to the node go.
    """
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    alive, rows, own = sim > -2.5, np.arange(len(node)), x[cand]
    out = np.full((len(node), params.degree), -1)
    for k in range(params.degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        p = cand[rows, first]
        out[some, k] = p[some]
        between = np.matmul(own, x[p][:, :, None])[:, :, 0]
        alive &= ~(some[:, None] & ((params.alpha**2 * (2 - 2 * between) <= 2 - 2 * sim) | (cand == p[:, None])))
    return out


def robust_prune(x: np.ndarray, params: GraphParams) -> np.ndarray:
    """Neighbours of each row of x (filled with -1), built by inserting the rows in batches that double in size.

    Each batch searches the graph so far from medoids; what it sees, and the batch's own members, are the
    candidates that are pruned. Links go both ways, and lists that overflow are pruned again. No step
    compares all rows with all rows but the first, of 64.
    """
    m = len(x)
    order = np.random.default_rng(params.seed).permutation(m)
    x = x[order]
    adj = np.full((m, params.degree), -1)
    done = 0
    while done < m:
        size = min(m - done, max(64, done))
        new = np.arange(done, done + size)
        parts = [(i, j, s) for i, j, s in greedy_search(x[new], x[:done], adj[:done], medoids(x[:done], params.entries), params)] if done else []
        own = x[new[: min(size, 64)]] @ x[new].T if not done else None
        wide = max([len(j) for _, j, _ in parts], default=0)
        wide = min(wide, 2 * params.beam)
        cand, sim = np.zeros((size, wide + (size if own is not None else 12)), int), np.full((size, wide + (size if own is not None else 12)), -3, x.dtype)
        for i, j, s in parts:
            best = np.argsort(-s, kind="stable")[:wide]
            cand[i, : len(best)], sim[i, : len(best)] = j[best], s[best]
        if own is not None:  # the first batch is small enough for all its pairs
            cand[:, wide:], sim[:, wide:] = new[None, :], own
            sim[np.arange(size), wide + np.arange(size)] = -3
        else:  # within a batch: rows that found the same nearest node stand next to each other
            nearest = cand[np.arange(size), sim[:, :wide].argmax(1)]
            line = np.lexsort((np.arange(size), nearest))
            where = np.empty(size, int)
            where[line] = np.arange(size)
            beside = where[:, None] + np.array([d for d in range(-6, 7) if d])[None, :]
            ok = (beside >= 0) & (beside < size)
            mate = line[np.clip(beside, 0, size - 1)]
            cand[:, wide:] = new[mate]
            sim[:, wide:] = np.where(ok, np.einsum("ijk,ik->ij", x[new[mate]], x[new]), -3)
        adj[new] = _prune(new, cand, sim, x, params)
        # links back; a node whose list overflows is pruned again over all its links
        a, b = np.repeat(new, params.degree), adj[new].ravel()
        a, b = a[b >= 0], b[b >= 0]
        old = np.flatnonzero(adj[: done + size].ravel() >= 0)
        pairs = np.unique(np.concatenate([b * m + a, old // params.degree * m + adj[: done + size].ravel()[old]]))
        node, to = pairs // m, pairs % m
        node, to = node[node != to], to[node != to]
        count = np.bincount(node, minlength=done + size)
        wide = int(count.max(initial=0))
        cand, sim = np.zeros((done + size, wide), int), np.full((done + size, wide), -3, x.dtype)
        place = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
        cand[node, place] = to
        sim[node, place] = np.einsum("ij,ij->i", x[node], x[to])
        over = np.flatnonzero(count > params.degree)
        keep = np.where(sim[:, : params.degree] > -2.5, cand[:, : params.degree], -1)
        adj[: done + size, : keep.shape[1]] = keep
        adj[: done + size, keep.shape[1] :] = -1
        if len(over):
            adj[over] = _prune(over, cand[over], sim[over], x, params)
        done += size
    out = np.full((m, params.degree), -1)
    out[order] = np.where(adj >= 0, order[adj], -1)
    return out


def _pack(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)


def _build(params: GraphParams):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        ids, x = pdf["cid"].to_numpy(), _pack(pdf).astype(np.float32)
        lists = [l[l >= 0] for l in robust_prune(x, params)]
        # within reach of both ends a query can only be if they are within twice its angle of each other
        least = 2 * (params.threshold - params.slack) ** 2 - 1
        return pd.DataFrame({"cid": ids, "near": [ids[l] for l in lists], "close": [ids[l[x[l] @ x[i] >= least]] for i, l in enumerate(lists)]})

    return run


def _search(params: GraphParams):
    """Of one shard's nodes and queries: ``cid, hits, root, moves`` of each query.

    A link is counted at the target's home, and only there, so that nothing is counted twice.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["role"] == 0].sort_values("cid").reset_index(drop=True)
        asked = pdf[pdf["role"] == 1].sort_values("cid").reset_index(drop=True)
        if not len(nodes) or not len(asked):
            return pd.DataFrame({"cid": [], "hits": [], "root": [], "moves": []}).astype({"cid": "int64", "hits": "int64", "root": "int64"})
        ids, exact = nodes["cid"].to_numpy(), _pack(nodes)
        x = exact.astype(np.float32)
        width = max(params.degree, max((len(l) for l in nodes["near"] if l is not None), default=0))
        adj = np.full((len(nodes), width), -1)
        for i, l in enumerate(nodes["near"]):
            if l is not None and len(l):
                at = np.searchsorted(ids, l)
                at = at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == l)]
                adj[i, : len(at)] = at
        home, copies, here = nodes["home"].to_numpy(), nodes["copies"].to_numpy(), pdf["shard"].iloc[0]
        mine = home == here
        members = np.flatnonzero(nodes["member"].to_numpy(bool))
        queries, who = _pack(asked), asked["cid"].to_numpy()
        out = []
        start = members[medoids(x[members], params.entries)] if len(members) else np.arange(min(params.entries, len(x)))
        for i, xi, s in greedy_search(queries.astype(np.float32), x, adj, start, params, params.threshold - params.slack):
            close = xi[(s >= params.threshold - params.slack)]
            close = close[ids[close] != who[i]]
            found = close[exact[close] @ queries[i] >= params.threshold]
            counted = found[mine[found]]
            root = min(int(who[i]), int(ids[found].min())) if len(found) else int(who[i])
            links = sorted({int(c) for c in ids[found]})
            out.append((int(who[i]), int(copies[counted].sum()), root, sorted(set(home[close]) - {here}), links))
        # links within a shard are told as a forest: each node to one of its component
        parent: dict[int, int] = {}

        def find(a: int) -> int:
            while parent.setdefault(a, a) != a:
                parent[a] = a = parent[parent[a]]
            return a

        for cid, _, _, _, links in out:
            for other in links:
                a, b = find(cid), find(other)
                parent[max(a, b)] = min(a, b)
        rows = {cid: (hits, find(cid), moves) for cid, hits, _, moves, _ in out}
        rows |= {cid: (0, find(cid), []) for cid in list(parent) if cid not in rows}
        return pd.DataFrame([(c, h, r, m) for c, (h, r, m) in rows.items()], columns=["cid", "hits", "root", "moves"]).astype({"cid": "int64", "hits": "int64", "root": "int64"})

    return run


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows with the digest of vector and label (null: links with nothing), and one row a digest, numbered by ``cid``."""
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), label.alias("label"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, v, l in zip(pdf["id"], pdf["v"], pdf["label"]):
                u = unit(v)
                if u is not None and l is not None and not pd.isna(i):
                    out.append((i, xxhash.xxh3_128_digest(np.asarray(v, np.float64).tobytes() + l.encode()), l, len(u), u.tobytes()))
                else:
                    out.append((i, None, None, 0, None))
            yield pd.DataFrame(out, columns=["id", "digest", "label", "dim", "unit"]).astype({"id": "Int64"})

    rows = durable(own.mapInPandas(clean, "id long, digest binary, label string, dim int, unit binary"))
    folded = rows.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("unit").alias("unit"))
    # numbers are given on a checkpoint, so a task done again gives the same ones
    return rows.select("id", "digest"), durable(durable(folded).withColumn("cid", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("digest")))


_ROUTED = "cid long, copies long, label string, dim int, unit binary, cluster int, part int, place int, visit boolean"


def _route(centres, params: GraphParams):
    """Rows of a vector for its two nearest centroids (``place`` 0 and 1) and all others that it enters (``place`` -1)."""

    def rows(pdf: pd.DataFrame, c: np.ndarray | None) -> Iterator[tuple[int, list[tuple[int, int, bool]]]]:
        s = _pack(pdf) @ c.T if c is not None and len(c) else np.ones((len(pdf), 1))
        order = np.argsort(-s, axis=1, kind="stable")
        go = s >= np.take_along_axis(s, order[:, :1], 1) - params.margin
        for i in range(len(pdf)):
            two = order[i, :2].tolist()
            yield i, [(j, two.index(j) if j in two else -1, bool(go[i, j])) for j in sorted({*two, *np.flatnonzero(go[i]).tolist()})]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, own in pdf.groupby("dim"):
                own = own.reset_index(drop=True)
                for i, to in rows(own, centres.value.get(int(d))):
                    r = own.iloc[i]
                    out += [(r.cid, r.copies, r.label, r.dim, r.unit, j, 0, place, visit) for j, place, visit in to]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _ROUTED.split(", ")])

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (d, _, _), own in pdf.groupby(["dim", "label", "cluster"]):
                own = own.reset_index(drop=True)
                sub = np.frombuffer(own["centres"].iloc[0], np.float64).reshape(-1, int(d))
                for i, to in rows(own, sub):
                    r = own.iloc[i]
                    # a member stays one of its nearest part; the cluster it came with decides whether that is its home
                    out += [(r.cid, r.copies, r.label, r.dim, r.unit, r.cluster, j, r.place if place == 0 else -1, bool(r.visit) and visit) for j, place, visit in to if place == 0 or visit and r.visit]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _ROUTED.split(", ")])

    return first, second


def _shards(classes: DataFrame, params: GraphParams) -> DataFrame:
    """``shard, cid, copies, unit, member, home, visit``: where each vector is a member, is at home and enters first."""
    n, dim = classes.agg(F.count("*"), F.max("dim")).first()
    take = max(1, min(params.max_fit_rows, 64_000_000 // (8 * dim)))
    by_dim: dict[int, list[bytes]] = {}
    for r in classes.orderBy("key", "digest").select("dim", "unit").limit(take).collect():  # at most 64 MB
        by_dim.setdefault(r.dim, []).append(bytes(r.unit))
    k = int(min(take // 5, max(1, n // params.per_cluster))) or 1
    centres = {d: centroids(np.frombuffer(b"".join(u), np.float64).reshape(-1, d), k, params.seed) for d, u in by_dim.items()}
    first, second = _route(classes.sparkSession.sparkContext.broadcast(centres), params)
    where = ["label", "dim", "cluster"]
    dealt = durable(classes.select("cid", "copies", "label", "dim", "unit").mapInPandas(first, _ROUTED))
    large = dealt.where("place >= 0").groupBy(*where).agg(F.count("*").alias("n")).where(F.col("n") > params.shard_rows)
    if not large.isEmpty():
        # of each large cluster about 4000 members, by hash, give its own centroids
        some = dealt.where("place >= 0").join(F.broadcast(large) if n < 10_000_000 else large, where).where(F.pmod(F.xxhash64("cid", F.lit(params.seed)), F.greatest(F.lit(1), (F.col("n") / 4000).cast("long"))) == 0)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("cid")
            c = centroids(_pack(pdf), max(2, int(-(-pdf["n"].iloc[0] // params.per_cluster))), params.seed)
            return pd.DataFrame({w: [pdf[w].iloc[0]] for w in where} | {"centres": [c.tobytes()]})

        subs = durable(some.select(*where, "n", "cid", "unit").groupBy(*where).applyInPandas(lambda pdf: fit(pdf), "label string, dim int, cluster int, centres binary"))
        split = dealt.join(subs, where).mapInPandas(second, _ROUTED)
        dealt = durable(dealt.join(subs.select(*where), where, "left_anti").unionByName(split))
    shard = F.concat_ws("|", "cluster", "part", "dim", "label")
    return dealt.select(shard.alias("shard"), "cid", "copies", "unit", (F.col("place") >= 0).alias("member"), (F.col("place") == 0).alias("home"), (F.col("visit") | (F.col("place") >= 0)).alias("visit"))


def _links(classes: DataFrame, params: GraphParams) -> tuple[DataFrame, DataFrame]:
    """``cid, hits`` (other vectors linked) and ``node, component`` over classes."""
    shards = _shards(classes, params)
    build, search = _build(params), _search(params)
    members = durable(shards.where("member").select("shard", "cid", "copies", "unit", "home"))
    lists = members.groupBy("shard").applyInPandas(lambda pdf: build(pdf[["cid", "unit"]]), "cid long, near array<long>, close array<long>")
    united = durable(lists.groupBy("cid").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "close")]))
    homes = members.where("home").select("cid", "copies", "unit", F.col("shard").alias("home"))
    node = homes.join(united.drop("close"), "cid", "left")
    # a shard's nodes: its members, and what their united lists lead to by links that a query within reach can follow
    inside = members.select("shard", "cid", F.lit(True).alias("member"))
    led = inside.join(united, "cid").select("shard", F.explode("close").alias("cid")).distinct().join(inside.select("shard", "cid"), ["shard", "cid"], "left_anti").withColumn("member", F.lit(False))
    placed = durable(inside.unionByName(led).join(node, "cid").select("shard", "cid", "copies", "unit", "home", "near", "member", F.lit(0).alias("role")))
    routes = durable(shards.where("visit").select("shard", "cid").distinct())
    every, found = routes, None
    while True:
        asked = routes.join(homes.select("cid", "copies", "unit", "home"), "cid").select(
            "shard", "cid", "copies", "unit", "home", F.lit(None).cast("array<long>").alias("near"), F.lit(False).alias("member"), F.lit(1).alias("role"))
        here = placed if found is None else placed.join(routes.select("shard").distinct(), "shard", "left_semi")
        got = durable(here.unionByName(asked).groupBy("shard").applyInPandas(lambda pdf: search(pdf), "cid long, hits long, root long, moves array<string>"))
        found = got if found is None else durable(found.unionByName(got))
        moved = got.select("cid", F.explode("moves").alias("shard")).distinct().select("shard", "cid")
        routes = durable(moved.join(every, ["shard", "cid"], "left_anti"))
        if routes.isEmpty():
            break
        every = durable(every.unionByName(routes))
    return found.groupBy("cid").agg(F.sum("hits").alias("hits")), components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))


def _audit(classes: DataFrame, hits: DataFrame, params: GraphParams) -> float:
    """Share of the links of audited classes that were found; counted by brute force over all.

    At most ``audit_rows`` classes are chosen by hash among all, and as many among those that have a link, since where
    links are rare the first may have none. If no audited class has one, recall is unknown: that is logged, and 1.
    """
    cut = lambda df: df.orderBy("key", "digest").limit(params.audit_rows).select("cid", "label", "dim", "unit")
    some = cut(classes).unionByName(cut(classes.join(hits.where("hits > 0").select("cid"), "cid", "left_semi"))).dropDuplicates(["cid"]).collect()
    asked = [(r.cid, r.label, r.dim, np.frombuffer(bytes(r.unit), np.float64)) for r in some]
    shared = classes.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shared.value), np.int64)
        for pdf in batches:
            for (d, l), own in pdf.groupby(["dim", "label"]):
                x, c, n = _pack(own), own["cid"].to_numpy(), own["copies"].to_numpy()
                for k, (cid, label, dim, u) in enumerate(shared.value):
                    if dim == d and label == l:
                        total[k] += int(n[(x @ u >= params.threshold) & (c != cid)].sum())
        yield pd.DataFrame({"cid": [a[0] for a in shared.value], "n": total})

    true = classes.select("cid", "copies", "label", "dim", "unit").mapInPandas(count, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))
    want, got = true.join(hits, "cid", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("hits", F.lit(0))))).first()
    logging.getLogger(__name__).info("audit of %d classes: %d of %d links found", len(some), got or 0, want or 0)
    if not want:
        logging.getLogger(__name__).warning("no audited class has a link, so recall is unknown")
    return got / want if want else 1.0


def embedding_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    params: GraphParams = GraphParams(),
) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null (``label_col=None``: all compared) and the cosine is at
    least ``params.threshold``. Exact copies are folded into one class and counted; n_links counts other vectors,
    and no pairs are emitted; component_id is the least id reachable by links. The index is approximate: if
    the audit finds less than ``least_recall`` of the links, it is searched again with twice the margin, and it is
    an error if that does not help. Null, empty, zero and non-finite vectors, null labels and null ids link
    with nothing; vectors of different lengths never link. Rows that share an id are vectors of their own, each
    with its own links and component. Other columns are not read; an empty table gives none.
    """
    rows, classes = _classes(vectors, id_col, vector_col, label_col)
    if classes.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    for margin in (params.margin, 2 * params.margin, 4 * params.margin):
        hits, comp = _links(classes, replace(params, margin=margin))
        hits, comp = durable(hits), durable(comp)
        recall = _audit(classes, hits, params)
        if recall >= params.least_recall:
            break
    else:
        raise RuntimeError(f"the index finds only {recall:.3f} of the audited links")
    named = classes.select("digest", "cid", "rep", "copies").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("of_all"))
    per_class = named.join(least, "component").join(hits, "cid", "left").select("digest", (F.col("copies") - 1 + F.coalesce("hits", F.lit(0))).alias("n_links"), F.col("of_all").alias("component"))
    return rows.join(per_class, "digest", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"),
    ).withColumn("kept", F.col(id_col).isNotNull() & (F.col(id_col) == F.col("component_id")))


def audit_recall(vectors: DataFrame, result: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", params: GraphParams = GraphParams()) -> float:
    """Recall of a result over at most ``params.audit_rows`` classes of vectors, by brute force over all rows."""
    rows, classes = _classes(vectors, id_col, vector_col, label_col)
    of = rows.join(result.select(F.col(id_col).alias("id"), "n_links"), "id").groupBy("digest").agg(F.max("n_links").alias("n"))
    return _audit(classes, classes.join(of, "digest").select("cid", (F.col("n") - F.col("copies") + 1).alias("hits")), params)
