"""Graph operators without a graph library."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.text import name_key
from metaloom.operators.lineage import durable


def concept_graph(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected edges ``(x, y, w)`` between known nodes, x < y; of repeated
    edges the last (by ``seq``) gives the weight."""
    keys = nodes.select(name_key(F.col("name")).alias("k")).distinct()
    e = triples.select(name_key(F.col("s")).alias("a"), name_key(F.col("o")).alias("b"), "conf", "seq").filter("a <> b")
    e = e.join(keys, e.a == keys.k, "left_semi").join(keys, e.b == keys.k, "left_semi")
    return e.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max_by("conf", "seq").alias("w"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the least node of each connected component, by minimum
    labels along edges and by jumping through labels of labels."""
    both = durable(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    label = durable(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("component")))
    while True:
        heard = both.join(label.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("heard"))
        low = label.join(heard, "node").select("node", "component", F.least("component", "heard").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("far"))
        after = durable(low.join(jump, "low").select("node", "component", F.least("low", "far").alias("new")))
        label = after.select("node", F.col("new").alias("component"))
        if after.filter("new <> component").isEmpty():
            return label


def twins(edges: DataFrame, weight: str) -> DataFrame:
    """``(node, twin)``: the least of the nodes that have the same neighbours by the same
    weights, which are told apart by 128 bits of hashes. Each pair of nodes is one edge."""
    both = edges.select("x", "y", weight).union(edges.select("y", "x", weight))
    marks = both.groupBy(F.col("x").alias("node")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("y", weight)).alias("h1"), F.bit_xor(F.xxhash64(F.lit("twin"), weight, "y")).alias("h2"))
    return marks.select("node", F.min("node").over(Window.partitionBy("n", "h1", "h2")).alias("twin"))


def among_first(edges: DataFrame, twin: DataFrame) -> DataFrame:
    """The edges of the first of all twins: these stand for all edges."""
    first = twin.filter("node = twin").select("node")
    return edges.join(first.withColumnRenamed("node", "x"), "x", "left_semi").join(first.withColumnRenamed("node", "y"), "y", "left_semi")


def greedy_communities(edges: list[tuple[str, str, int]], m: int, members: dict[str, list[str]]) -> dict[str, str]:
    """Agglomeration by modularity gain, (gain, then the least pair of labels); a
    community's label is its least node. edges: of the first of all twins, with their
    numbers; members: all twins of each; m: edges of the whole graph.

    A group is a community, or those of the twins that are alone yet: of these the least
    one goes first, and they share one row of links. Of two groups the one of the larger
    degree keeps the pair, with its best pair on the heap. That is never worse than what
    the group has: a gain falls as degrees grow, and what rises is compared at once."""
    name = {c: k for k, c in enumerate(sorted(members))}
    alone = {k: sorted(members[c], reverse=True) for c, k in name.items()}  # the least is the last
    label = {k: nodes[-1] for k, nodes in alone.items()}
    within: dict[int, list[str]] = {}
    links: dict[int, dict[int, int]] = defaultdict(dict)
    degree: dict[int, int] = defaultdict(int)
    for x, y, n in edges:
        i, j = name[x], name[y]
        links[i][j] = links[j][i] = n
        degree[i] += n * len(members[y])
        degree[j] += n * len(members[x])
    a = {k: d / (2 * m) for k, d in degree.items()}
    best: dict[int, tuple | None] = dict.fromkeys(a)
    heap: list[tuple] = []

    def entry(i: int, j: int) -> tuple:
        return (-2 * (links[i][j] / (2 * m) - a[i] * a[j]), min(label[i], label[j]), max(label[i], label[j]), i, j)

    def keeps(i: int, j: int) -> bool:
        return (a[i], i) > (a[j], j)

    def put(i: int, found: tuple | None) -> None:
        best[i] = found
        if found:
            heapq.heappush(heap, found)

    def scan(i: int) -> None:
        most, found, at = a[i], [], 0.0
        for j, n in links[i].items():
            if a[j] <= most and keeps(i, j):
                g = -2 * (n / (2 * m) - most * a[j])
                if not found or g < at:
                    found, at = [j], g
                elif g == at:
                    found.append(j)
        put(i, min((entry(i, j) for j in found), default=None))

    for k in a:
        scan(k)
    while heap:
        top = heapq.heappop(heap)
        g, _, _, i, j = top
        if best.get(i) is not top:
            continue
        if g >= 0:
            break
        if j not in links[i] or not keeps(i, j) or entry(i, j) != top:
            scan(i)
            continue
        keeper, nodes, low, sum_ = i, [], min(label[i], label[j]), a[i] + a[j]
        one = [k for k in (i, j) if k in within or len(alone[k]) == 1]  # these end as groups of their own
        for k in (i, j):
            mine = within.pop(k) if k in within else [alone[k].pop()]
            nodes, mine = (mine, nodes) if len(mine) > len(nodes) else (nodes, mine)
            nodes += mine
            if alone[k]:
                label[k] = alone[k][-1]
        if one:
            new = max(one, key=lambda k: len(links[k]))
            other = j if new == i else i
        else:
            new, other = len(label), j
            for k, n in links[i].items():
                links[new][k] = links[k][new] = n
            alone[new] = []
        for k, n in list(links[other].items()):
            if k != new:
                links[new][k] = links[k][new] = links[new].get(k, 0) + n
        if other in one:
            for k in links.pop(other):
                del links[k][other]
            del best[other], a[other]
        within[new], label[new], a[new] = nodes, low, sum_
        scan(new)
        if keeper != new and keeper in best:
            scan(keeper)
        for k in links[new]:
            if a[k] >= sum_ and keeps(k, new):
                rival = entry(k, new)
                if best[k] is None or rival < best[k]:
                    put(k, rival)
    return {n: n for left in alone.values() for n in left} | {n: label[k] for k, nodes in within.items() for n in nodes}


def communities(edges: DataFrame) -> DataFrame:
    """``(node, community)``; merging across components never gains, so each
    component is solved for itself with the edge count of the whole graph. Its task holds
    all nodes, but the edges only of the first of all twins."""
    pairs = durable(edges.groupBy("x", "y").agg(F.count("*").alias("n")))
    twin = durable(twins(pairs, "n"))
    few = durable(among_first(pairs, twin))
    label = components(few)
    total = pairs.agg(F.sum("n").alias("m"))
    rows = few.join(label.withColumnRenamed("node", "x"), "x").select("component", "x", "y", "n")
    nodes = twin.join(label.withColumnRenamed("node", "twin"), "twin").select("component", F.col("twin").alias("x"), F.col("node").alias("y"), F.lit(0).cast("long").alias("n"))
    rows = rows.union(nodes).crossJoin(F.broadcast(total))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf.n > 0].sort_values(["x", "y"])
        members = {c: list(y) for c, y in pdf[pdf.n == 0].groupby("x")["y"]}
        found = greedy_communities(list(zip(e.x, e.y, map(int, e.n))), int(pdf.m.iloc[0]), members)
        return pd.DataFrame({"node": list(found), "community": list(found.values())})

    return rows.groupBy("component").applyInPandas(solve, "node string, community string")


def structural_holes(edges: DataFrame, groups: DataFrame, below: float = 0.05) -> DataFrame:
    """Pairs of communities with few edges for their sizes."""
    size = groups.groupBy("community").agg(F.count("*").alias("n"))
    a, b = size.select(F.col("community").alias("i"), F.col("n").alias("n_i")), size.select(F.col("community").alias("j"), F.col("n").alias("n_j"))
    ends = edges.join(groups.select(F.col("node").alias("x"), F.col("community").alias("cx")), "x").join(groups.select(F.col("node").alias("y"), F.col("community").alias("cy")), "y")
    cross = ends.groupBy(F.least("cx", "cy").alias("i"), F.greatest("cx", "cy").alias("j")).agg(F.count("*").alias("edges"))
    pairs = a.join(b, F.col("i") < F.col("j")).join(cross, ["i", "j"], "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return pairs.withColumn("density", F.col("edges") / (F.col("n_i") * F.col("n_j"))).filter(F.col("density") < below)


def brandes(edges: list[tuple[str, str, float]], sources: list[str], size: dict[str, int]) -> dict[str, float]:
    """Dependencies of each node on all of the given sources, weights as distances. edges:
    of the first of all twins; size: how many there are of each, whose scores are equal.
    The source's own twins are a node beside it (None)."""
    near: dict[str | None, list[tuple[str | None, float]]] = defaultdict(list)
    for x, y, w in edges:
        near[x].append((y, w))
        near[y].append((x, w))
    score: dict[str, float] = defaultdict(float)
    many: dict[str | None, int] = dict(size)
    for s in sources:
        many[s], many[None] = 1, size[s] - 1
        near[None] = near[s] if size[s] > 1 else []
        beside = {y: w for y, w in near[None]}
        dist: dict[str | None, float] = {}
        seen: dict[str | None, float] = {s: 0.0}
        paths: dict[str | None, float] = defaultdict(float)
        paths[s] = 1.0
        back: dict[str | None, list[str | None]] = defaultdict(list)
        order = []
        heap: list[tuple[float, int, str | None]] = [(0.0, 0, s)]
        pushed = 0
        while heap:
            d, _, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for w, c in [*near[v], (None, beside[v])] if v in beside else near[v]:
                far = d + c
                if w not in dist and (w not in seen or far < seen[w]):
                    seen[w] = far
                    pushed += 1
                    heapq.heappush(heap, (far, pushed, w))
                    paths[w] = paths[v] * many[v]
                    back[w] = [v]
                elif w in seen and far == seen[w] and w not in dist:
                    paths[w] += paths[v] * many[v]
                    back[w].append(v)
        delta: dict[str | None, float] = defaultdict(float)
        for w in reversed(order):
            for v in back[w]:
                delta[v] += many[w] * (paths[v] / paths[w] * (1 + delta[w]))
            if w is None:
                score[s] += many[w] * delta[w]
            elif w != s:
                score[w] += size[s] * delta[w]
        many[s] = size[s]
    return score


def betweenness(edges: DataFrame, nodes: int, chunk: int = 64) -> DataFrame:
    """``(node, centrality)``, scaled by (n-1)(n-2). The first of all twins stand for
    the others, as sources and in the edges. Sources are chunked within their component
    and meet its edges by a shuffle; nothing is broadcast. Sums do not depend on the order of rows."""
    twin = durable(twins(edges, "w"))
    few = durable(among_first(edges, twin).select("x", "y", "w"))
    label = components(few).join(twin.groupBy(F.col("twin").alias("node")).agg(F.count("*").alias("size")), "node")
    part = (F.abs(F.xxhash64("node")) % F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))).alias("part")
    sized = durable(label.join(label.groupBy("component").agg(F.count("*").alias("n")), "component").select("component", "node", "size", part))
    parts = sized.select("component", "part").distinct()
    none = F.lit(None)
    # three kinds of rows: sources, sizes, edges
    sources = sized.select("component", "part", F.col("node").alias("x"), none.cast("string").alias("y"), none.cast("double").alias("w"), none.cast("long").alias("size"))
    sizes = sized.select("component", F.col("node").alias("x"), "size").join(parts, "component").select("component", "part", "x", none.cast("string").alias("y"), none.cast("double").alias("w"), "size")
    owned = few.join(sized.select("component", F.col("node").alias("x")), "x").join(parts, "component").select("component", "part", "x", "y", "w", none.cast("long").alias("size"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf.y.notna()].sort_values(["x", "y"])
        n = pdf[pdf["size"].notna()].sort_values("x")
        found = brandes(list(zip(e.x, e.y, e.w)), sorted(pdf[pdf.y.isna() & pdf["size"].isna()].x), dict(zip(n.x, n["size"].astype(int))))
        return pd.DataFrame({"twin": list(found), "v": list(found.values())})

    found = sources.union(sizes).union(owned).groupBy("component", "part").applyInPandas(solve, "twin string, v double").groupBy("twin").agg(F.array_sort(F.collect_list("v")).alias("v"))
    sums = found.select("twin", F.aggregate("v", F.lit(0.0), lambda total, v: total + v).alias("v"))
    return twin.join(sums, "twin").select("node", (F.col("v") / max(1, (nodes - 1) * (nodes - 2))).alias("centrality"))


def closure(pairs: DataFrame) -> DataFrame:
    """Transitive closure of ``(child, parent)`` by doubling path lengths, a
    logarithmic number of rounds; loops come out once."""
    have = durable(pairs.select("child", "parent").distinct())
    n = have.count()
    while True:
        more = have.join(have.select(F.col("child").alias("parent"), F.col("parent").alias("up")), "parent").select("child", F.col("up").alias("parent"))
        have = durable(have.union(more).distinct())
        before, n = n, have.count()
        if n == before:
            return have


def worst(rows: DataFrame, order: list, keep: int) -> DataFrame:
    """The first ``keep`` rows in an order, and one row with the number of the
    others (``more``; null in the rows shown). 0 shows nothing at all."""
    shown = rows.orderBy(*order).limit(keep).withColumn("more", F.lit(None).cast("bigint"))
    if not keep:
        return shown
    rest = rows.agg(F.count("*").alias("n")).filter(F.col("n") > keep)
    return shown.unionByName(rest.select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes], (F.col("n") - keep).alias("more")))
