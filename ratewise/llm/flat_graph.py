"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors are dealt to overlapping cluster shards (the centroids come from a
bounded sample; shards that are still large are divided by centroids of their
own, level by level). Each shard builds its graph: nearest candidates by blocks,
thinned by robust pruning, with edges both ways. A vector's adjacency lists of
its shards are united. A search starts at a shard's medoid (and at the query's
own node), walks greedily with a beam, then expands its range: every node near
the query is expanded until no near node is left. Neighbours of those nodes
that lie in other shards send the query on to them, round by round, until none
is new, but only where the angles between query, node and neighbour allow the
neighbour to be near too (triangle inequality): a vector without near ones asks
one shard, however many shards there are.
Links are cosines in double precision. An audit holds a bounded sample of
queries against all vectors, in blocks, and widens the search if recall is low.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_sorted
from .components import components


@dataclass(frozen=True)
class Params:
    threshold: float = 0.95
    #: Vectors a shard is meant to hold, and queries dealt to one task.
    shard_rows: int = 1500
    #: Shards that a vector is indexed in.
    overlap: int = 2
    #: Bound of the sample that the centroids come from, and of the audit's queries.
    sample: int = 16_384
    audit: int = 512
    candidates: int = 48
    degree: int = 16
    alpha: float = 1.2
    beam: int = 24
    #: The range search goes on through nodes this much below the threshold.
    slack: float = 0.1
    #: Recall that the audit asks for.
    recall: float = 0.9


def unit(vectors):
    """Rows in double precision, scaled to length 1."""
    import numpy as np

    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(col: str):
    """Not null, not zero, every component finite."""
    fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(col, lambda x: x != 0), F.lit(False))


def centroids(sample, k: int, rounds: int = 5):
    """Spherical k-means of unit vectors, started at the first k."""
    import numpy as np

    c = sample[:k].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[a:a + 2048] @ c.T).argmax(axis=1) for a in range(0, len(sample), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def shard_plan(reps: DataFrame, n: int, p: Params) -> dict:
    """Centroids by dimension, from the reps first by a hash of their id."""
    import numpy as np

    rows = reps.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(p.sample).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["embedding"]), []).append(r["embedding"])
    k = lambda m: max(1, min(len(m) // 4, -(-n * len(m) // (len(rows) * p.shard_rows))))
    return {d: centroids(unit(m), k(m)) for d, m in by.items()}


def deal(reps: DataFrame, plan: dict, p: Params) -> DataFrame:
    """(id, embedding, mult, shard, home): a row for each shard that holds the vector."""
    def run(batches):
        import numpy as np

        base = {d: sum(len(plan[e]) for e in sorted(plan) if e < d) for d in plan}
        for batch in batches:
            if not len(batch):
                continue
            size = batch["embedding"].map(len)
            for d, part in batch.groupby(size):
                if d not in plan:  # a dimension that the sample missed: one shard of its own
                    yield part.assign(shard=-int(d), home=True)
                    continue
                c = plan[d]
                near = np.argsort(-(unit(part["embedding"]) @ c.T), axis=1)[:, : p.overlap]
                for j in range(near.shape[1]):
                    yield part.assign(shard=near[:, j] + base[d], home=j == 0)

    kind = reps.schema["embedding"].dataType.simpleString()
    return reps.select("id", "embedding", "mult").mapInPandas(run, f"id long, embedding {kind}, mult long, shard long, home boolean")


def robust_prune(x, p: Params):
    """Neighbours of each row of unit vectors: nearest first, dropping candidates that a kept one covers; -1 pads."""
    import numpy as np

    m = len(x)
    c = min(p.candidates, m - 1)
    out = np.full((m, p.degree), -1, np.int64)
    for a in range(0, m, 256) if c > 0 else ():
        s = x[a:a + 256] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        cand = np.argpartition(-s, c - 1, axis=1)[:, :c]
        order = np.argsort(-np.take_along_axis(s, cand, axis=1), axis=1, kind="stable")
        cand = np.take_along_axis(cand, order, axis=1)
        sims = np.take_along_axis(s, cand, axis=1)
        dist = np.sqrt(np.maximum(0, 2 - 2 * sims))
        vec = x[cand]
        alive = np.ones(cand.shape, bool)
        rows = np.arange(len(s))
        for j in range(p.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            out[a:a + len(s)][some, j] = cand[rows, pick][some]
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rd,rcd->rc", vec[rows, pick], vec)))
            alive &= p.alpha * between > dist
            alive[rows, pick] = False
    return out


def build(shard: pd.DataFrame, p: Params) -> pd.DataFrame:
    """Edges (id, neighbour, cosine) of a shard's graph, both ways.

    A node keeps its nearest 2 x degree, and the way back from each node to
    which it is the nearest, so that every node can be reached.
    """
    import numpy as np

    ids = shard["id"].to_numpy()
    x = unit(shard["embedding"])
    near = robust_prune(x, p)
    a, b = np.repeat(np.arange(len(ids)), p.degree), near.ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
    nearest = near[b, 0] == a
    sims = np.concatenate([np.einsum("ed,ed->e", x[a[k:k + 65536]], x[b[k:k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)])
    order = np.lexsort((-sims, a))
    a, b, nearest, sims = a[order], b[order], nearest[order], sims[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = (place < 2 * p.degree) | nearest
    return pd.DataFrame({"id": ids[a[keep]], "near": ids[b[keep]], "cosine": sims[keep]})


def divide(rows: DataFrame, p: Params) -> DataFrame:
    """``rows`` (id, embedding, mult, shard, home) with a column cluster: shards of over four times the size wanted are
    divided by centroids of a bounded sample of their own, and their parts again, until all are small.

    A home row goes on to ``overlap`` parts, of which one is its home, another
    row to one. A part that keeps over three quarters of its rows isn't divided
    further.
    """
    def own_centroids(rows):
        x, k = unit(rows["embedding"]), int(rows["k"].iloc[0])
        c = centroids(x, min(k, len(x)))
        return pd.DataFrame({"cluster": rows["cluster"].iloc[0], "place": range(len(c)), "centroid": list(c)})

    def choose(rows, cents):
        import numpy as np

        if not len(rows) or not len(cents):  # no centroid was drawn
            return rows.assign(was=rows["n"])[cols]
        c = np.stack(cents.sort_values("place")["centroid"].to_numpy())
        near = np.argsort(-(unit(rows["embedding"]) @ c.T), axis=1, kind="stable")[:, : p.overlap]
        home, out = rows["home"].to_numpy(bool), []
        for j in range(near.shape[1]):
            part = rows.assign(cluster=rows["cluster"] + "." + near[:, j].astype(str), home=home & (j == 0), was=rows["n"])
            out.append(part if j == 0 else part[home])
        return pd.concat(out)[cols]

    cols = ["id", "embedding", "mult", "home", "cluster", "was"]
    schema = f"id long, embedding {rows.schema['embedding'].dataType.simpleString()}, mult long, home boolean, cluster string, was long"
    left, done, level, limit = rows.withColumn("cluster", F.col("shard").cast("string")).withColumn("was", F.lit(None).cast("long")).select(*cols), None, 0, 4 * p.shard_rows
    while True:
        sizes = left.groupBy("cluster").agg(F.count("*").alias("n"), F.min("was").alias("_was"))
        sizes = materialize(sizes.select("cluster", "n", ((F.col("n") > limit) & F.coalesce(F.col("n") <= 0.75 * F.col("_was"), F.lit(True))).alias("large")), "cluster-sizes")
        if sizes.where("large").isEmpty():
            return left.drop("was") if done is None else done.unionByName(left.drop("was"))
        small = left.join(sizes.where("not large").select("cluster"), "cluster", "left_semi").drop("was")
        done = small if done is None else done.unionByName(small)
        large = left.drop("was").join(sizes.where("large").select("cluster", "n"), "cluster")
        k = F.least(F.ceil(F.col("n") / p.shard_rows), F.lit(max(2, p.sample // 4))).cast("long")
        drawn = large.withColumn("k", k).where(F.pmod(F.xxhash64(F.lit(f"divide{level}"), "id"), F.col("n")) < 4 * F.col("k"))
        cents = materialize(drawn.select("cluster", "k", "embedding").groupBy("cluster").applyInPandas(own_centroids, "cluster string, place int, centroid array<double>"), "own-centroids")
        dealt, counts = blocks(large, "cluster", limit)
        spread = cents.join(counts, "cluster").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1))).drop("_blocks")
        left = materialize(dealt.groupBy("cluster", "block").cogroup(spread.groupBy("cluster", "block")).applyInPandas(choose, schema), "divided")
        level += 1


def search(nodes: pd.DataFrame, queries: pd.DataFrame, p: Params) -> pd.DataFrame:
    """Rows (q, kind, other, weight): "n" links counted at home nodes, "e" an edge of the components, "x" a shard to visit."""
    import numpy as np

    nodes = nodes.drop_duplicates("id")
    queries = queries.groupby("q", as_index=False).first()
    ids, x = nodes["id"].to_numpy(), unit(nodes["embedding"])
    home, mult = nodes["home"].to_numpy(bool), nodes["mult"].to_numpy(np.int64)
    here, m = int(nodes["shard"].iloc[0]), len(nodes)
    order = np.argsort(ids)
    local = lambda v: np.where(ids[order[np.minimum(np.searchsorted(ids, v, sorter=order), m - 1)]] == v, order[np.minimum(np.searchsorted(ids, v, sorter=order), m - 1)], -1)
    lists = [np.array([], np.int64) if v is None else np.asarray(v, np.int64) for v in nodes["near"]]
    homes = [np.array([], np.int64) if v is None else np.asarray(v, np.int64) for v in nodes["near_home"]]
    angles = [np.array([]) if v is None else np.arccos(np.clip(np.asarray(v, np.float64), -1, 1)) for v in nodes["near_cosine"]]
    adj = np.full((m, max([1, *map(len, lists)])), -1, np.int64)
    away, turn = [], []  # shards of neighbours elsewhere, and the angles to the nearest of them
    for i, (v, h, w) in enumerate(zip(lists, homes, angles)):
        at = local(v) if len(v) else v
        adj[i, : len(v)] = at
        out_of = (at < 0) & (h != here) if len(v) else np.zeros(0, bool)
        order_ = np.argsort(w[out_of], kind="stable")
        shards, first_ = np.unique(h[out_of][order_], return_index=True)
        away.append(shards)
        turn.append(w[out_of][order_][first_])
    at_home = nodes["home_shard"].to_numpy()
    medoid = int((x @ x.mean(axis=0)).argmax())
    out = []
    edge = p.threshold - p.slack
    for first in range(0, len(queries), 2048):
        block = queries.iloc[first:first + 2048]
        q, y = block["q"].to_numpy(), unit(block["vector"])
        n = len(q)
        own = local(q)
        start = np.stack([np.full(n, medoid), own, local(block["entry"].to_numpy())], axis=1)
        seen = np.zeros((n, m), bool)
        pool = np.full((n, p.beam), -1, np.int64)
        score = np.full((n, p.beam), -np.inf)
        fresh = np.zeros((n, p.beam), bool)
        near_q, near_n, near_s = [], [], []

        def visit(rows, cand):
            """Similarities of unseen candidates (-inf elsewhere); near ones are noted."""
            ok = cand >= 0
            ok &= ~seen[rows[:, None], np.maximum(cand, 0)]
            dup = np.sort(np.where(ok, cand, -1), axis=1)
            if cand.shape[1] > 1 and (dup[:, 1:] == dup[:, :-1])[dup[:, 1:] >= 0].any():
                for j in range(1, cand.shape[1]):
                    ok[:, j] &= ~((cand[:, :j] == cand[:, j:j + 1]) & ok[:, :j]).any(axis=1)
            r, k = np.nonzero(ok)
            s = np.full(cand.shape, -np.inf)
            s[r, k] = np.einsum("ed,ed->e", y[rows[r]], x[cand[r, k]])
            seen[rows[r], cand[r, k]] = True
            hit = s[r, k] >= edge
            near_q.append(rows[r[hit]]), near_n.append(cand[r, k][hit]), near_s.append(s[r, k][hit])
            return s

        def merge(rows, cand, s):
            both, sims = np.concatenate([pool[rows], cand], axis=1), np.concatenate([score[rows], s], axis=1)
            new = np.concatenate([fresh[rows], np.isfinite(s)], axis=1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, : p.beam]
            pool[rows], score[rows], fresh[rows] = (np.take_along_axis(v, top, axis=1) for v in (both, sims, new))

        rows = np.arange(n)
        merge(rows, start, visit(rows, start))
        while len(rows := np.flatnonzero(fresh.any(axis=1))):
            best = np.where(fresh[rows], score[rows], -np.inf).argmax(axis=1)
            fresh[rows, best] = False
            cand = adj[pool[rows, best]]
            merge(rows, cand, visit(rows, cand))
        done = 0
        while done < len(near_q):
            fq, fn = np.concatenate(near_q[done:]), np.concatenate(near_n[done:])
            done = len(near_q)
            step = max(1, 4_000_000 // adj.shape[1])
            for k in range(0, len(fq), step):
                cand = adj[fn[k:k + step]].ravel()
                rows = np.repeat(fq[k:k + step], adj.shape[1])
                ok = cand >= 0
                cand, rows = cand[ok], rows[ok]
                ok = ~seen[rows, cand]
                pair = np.unique(rows[ok] * m + cand[ok])
                if len(pair):
                    visit_rows, cand = pair // m, pair % m
                    visit(visit_rows, cand[:, None])
        fq, fn, fs = np.concatenate(near_q), np.concatenate(near_n), np.concatenate(near_s)
        link = (fs >= p.threshold) & (ids[fn] != q[fq])
        count = np.bincount(fq[link], weights=(mult * home)[fn[link]], minlength=n).astype(np.int64)
        out.append(pd.DataFrame({"q": q, "kind": "n", "other": 0, "weight": count}))
        low = np.minimum(q, np.iinfo(np.int64).max)
        np.minimum.at(low, fq[link], ids[fn[link]])
        reach = ids.copy()
        np.minimum.at(reach, fn[link], low[fq[link]])
        out.append(pd.DataFrame({"q": q, "kind": "e", "other": low, "weight": 0})[low != q])
        hung = reach != ids
        out.append(pd.DataFrame({"q": ids[hung], "kind": "e", "other": reach[hung], "weight": 0}))
        # a query and the node that gave it its low id are linked; so is each node with a query that reached it
        cross = pd.DataFrame({"q": q[fq[link]], "low": low[fq[link]], "n": reach[fn[link]]}).drop_duplicates(["low", "n"])
        cross = cross[cross["low"] != cross["n"]]
        out.append(pd.DataFrame({"q": cross["low"], "kind": "e", "other": cross["n"], "weight": 0}))
        gone = [(fq[link], at_home[fn[link]], ids[fn[link]])]
        lone = np.array([len(v) for v in away])
        rep = np.repeat(np.arange(len(fn)), lone[fn])
        if len(rep):
            reachable = np.concatenate([turn[i] for i in fn]) <= np.arccos(np.clip(fs[rep], -1, 1)) + np.arccos(edge) + 1e-6
            gone.append((fq[rep][reachable], np.concatenate([away[i] for i in fn])[reachable], ids[fn[rep]][reachable]))
        gq, gs, gn = (np.concatenate(v) for v in zip(*gone))
        far = pd.DataFrame({"q": q[gq], "kind": "x", "other": gs, "weight": gn})[gs != here]
        out.append(far.drop_duplicates(["q", "other"]))
    return pd.concat(out, ignore_index=True)


def blocks(rows: DataFrame, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a block number of their key, at most about ``size`` rows each; and (key, blocks)."""
    counts = materialize(rows.groupBy(key).agg(F.ceil(F.count("*") / size).alias("_blocks")), "blocks")
    dealt = rows.join(counts, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    return dealt.drop("_blocks"), counts


def link_counts(reps: DataFrame, n: int, p: Params) -> tuple[DataFrame, DataFrame]:
    """((id, links), (u, v)) for reps (id, embedding, mult): weighted link counts, and edges that span the components."""
    held, _ = blocks(divide(materialize(deal(reps, shard_plan(reps, n, p), p), "dealt"), p), "cluster", 4 * p.shard_rows)
    # a cluster that centroids don't divide is split by a hash; every query of it then visits each part
    held = materialize(held.withColumn("part", F.concat_ws("/", "cluster", F.col("block").cast("string"))).drop("block"), "held")
    names = number_sorted(held.select("part", "cluster").distinct().sortWithinPartitions("part"), "pid", "parts")
    names = materialize(names, "part-names")
    held = held.join(names.select("part", "pid"), "part")
    held = materialize(held.select("id", "embedding", "mult", "home", "cluster", F.col("pid").alias("shard")), "parted")
    edges = held.select("shard", "id", "embedding").groupBy("shard").applyInPandas(lambda s: build(s, p), "id long, near long, cosine double")
    home = held.where("home").select("id", F.col("shard").alias("home_shard"))
    lists = materialize(edges.groupBy("id", "near").agg(F.max("cosine").alias("cosine")), "edges").join(home.select(F.col("id").alias("near"), F.col("home_shard").alias("near_home")), "near")
    lists = lists.groupBy("id").agg(F.collect_list(F.struct("near", "near_home", "cosine")).alias("l"))
    nodes = held.join(home, "id").join(lists, "id", "left").select(
        "shard", "id", "embedding", "mult", "home", "home_shard", F.col("l.near").alias("near"), F.col("l.near_home").alias("near_home"), F.col("l.cosine").alias("near_cosine"))
    nodes = materialize(nodes, "nodes")
    vectors = nodes.where("home").select(F.col("id").alias("q"), F.col("embedding").alias("vector"))
    sent = held.where("home").select(F.col("id").alias("q"), "cluster").join(names.select("cluster", "pid"), "cluster").select("q", F.col("pid").alias("shard"), F.col("q").alias("entry"))
    sent = materialize(sent, "sent")
    gone, found = None, []
    while not sent.isEmpty():
        asked, counts = blocks(sent.withColumn("id", F.col("q")), "shard", 2 * p.shard_rows)
        asked = asked.select("shard", "block", "q", "entry").join(vectors, "q")
        spread = nodes.join(counts, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1))).drop("_blocks")
        met = spread.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(
            lambda a, b: search(a, b, p) if len(a) and len(b) else pd.DataFrame({"q": [], "kind": [], "other": [], "weight": []}),
            "q long, kind string, other long, weight long")
        met = materialize(met, "met")
        found.append(met)
        gone = sent.select("q", "shard") if gone is None else gone.unionByName(sent.select("q", "shard"))
        more = met.where("kind = 'x'").groupBy("q", F.col("other").alias("shard")).agg(F.min("weight").alias("entry"))
        sent = materialize(more.join(gone, ["q", "shard"], "left_anti"), "sent")
    met = found[0]
    for f in found[1:]:
        met = met.unionByName(f)
    counts = met.where("kind = 'n'").groupBy(F.col("q").alias("id")).agg(F.sum("weight").alias("links"))
    return materialize(counts, "link-counts"), met.where("kind = 'e'").select(F.col("q").alias("u"), F.col("other").alias("v"))


def audit(reps: DataFrame, counts: DataFrame, p: Params) -> float | None:
    """Share of the links of a bounded sample of queries, held against all reps in blocks, that the search has
    counted; null if the sample has no link, which tells nothing about the recall."""
    import numpy as np

    asked = reps.orderBy(F.xxhash64(F.lit("audit"), "id"), "id").limit(p.audit).select("id", "embedding").collect()
    by: dict[int, tuple] = {}
    for d in {len(r["embedding"]) for r in asked}:
        own = [r for r in asked if len(r["embedding"]) == d]
        by[d] = (np.array([r["id"] for r in own]), unit([r["embedding"] for r in own]))

    def run(batches):
        for batch in batches:
            for d, part in batch.groupby(batch["embedding"].map(len)):
                if d in by:
                    q, y = by[d]
                    x, ids, mult = unit(part["embedding"]), part["id"].to_numpy(), part["mult"].to_numpy()
                    total = ((y @ x.T >= p.threshold) & (q[:, None] != ids)) @ mult
                    yield pd.DataFrame({"id": q, "truth": total})

    truth = reps.select("id", "embedding", "mult").mapInPandas(run, "id long, truth long").groupBy("id").agg(F.sum("truth").alias("truth"))
    got = truth.join(counts, "id").agg(F.sum(F.least("truth", "links")), F.sum("truth")).first()
    return got[0] / got[1] if got[1] else None


def near_duplicates(vectors: DataFrame, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept, audited_recall.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and are their own component. Vectors of different length
    never link. Equal vectors are one node: they link with each other and share
    their links. component_id is the smallest id reachable; null ids count last.
    audited_recall is null where the vector can't be compared, and everywhere if
    the audit met no link. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"))
    good = rows.where(usable("embedding"))
    grouped = good.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"))
    reps = materialize(number_sorted(grouped.sortWithinPartitions("low"), "id", "reps"), "reps")
    alone = rows.where(~usable("embedding")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("audited_recall"))
    n = reps.count()
    if not n:
        return alone
    recall, tried = 0.0, p
    for _ in range(3):
        counts, edges = link_counts(reps, n, tried)
        recall = audit(reps, counts, tried)
        if recall is None or recall >= p.recall:
            break
        tried = replace(tried, beam=2 * tried.beam, overlap=tried.overlap + 1, slack=min(1.5 * tried.slack, 0.4))
    else:
        raise RuntimeError(f"the audit finds a recall of {recall:.3f}; raise beam, overlap or slack")
    roots = materialize(components(edges, "vectors"), "roots")
    rooted = materialize(reps.join(counts, "id").join(roots, F.col("id") == F.col("node"), "left").select(
        "id", "embedding", "low", (F.col("links") + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("root")), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = materialize(rooted.join(lows, "root").select("embedding", "n_links", "component_id"), "known")
    out = good.join(known, "embedding").select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
    return out.unionByName(alone)
