"""Graph operators against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from metaloom.operators import fuzzy, graph, ontology
from metaloom.sources import bindings


def paths_betweenness(nodes, edges):
    near = {n: {} for n in nodes}
    for x, y, w in edges:
        near[x][y] = near[y][x] = w

    def walks(path, length):
        yield path, length
        for n, w in near[path[-1]].items():
            if n not in path:
                yield from walks([*path, n], length + w)

    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        best = {}
        for path, length in walks([s], 0.0):
            best.setdefault(path[-1], []).append((length, path))
        for t, found in best.items():
            least = min(d for d, _ in found)
            short = [p for d, p in found if d == least]
            for p in short:
                for v in p[1:-1]:
                    score[v] += 1 / len(short)
    return score


def test_betweenness(spark):
    rng = random.Random(4)
    nodes = list("abcdefg")
    edges = [(x, y, rng.choice([0.5, 1.0])) for x, y in itertools.combinations(nodes, 2) if rng.random() < 0.4]
    got = {r.node: r.centrality for r in graph.betweenness(spark.createDataFrame(edges, "x string, y string, w double"), 7, chunk=2).collect()}
    want = paths_betweenness(nodes, edges)
    assert all(abs(got.get(n, 0) - want[n] / 30) < 1e-9 for n in nodes)


def test_betweenness_of_twins(spark):
    """Twins are sources, ends and ways of each other's paths; equal lengths share."""
    rng = random.Random(11)
    for sizes in ([3, 2, 1], [1, 3, 2, 1], [2, 2, 2]):
        edges = [(x, y, 1.0) for x, y in blown_up(rng, sizes, 1.0)] + [("n00", "z", 0.5)]
        nodes = sorted({n for x, y, _ in edges for n in (x, y)})
        got = {r.node: r.centrality for r in graph.betweenness(spark.createDataFrame(edges, "x string, y string, w double"), len(nodes), chunk=2).collect()}
        want = paths_betweenness(nodes, edges)
        assert all(abs(got.get(n, 0) - want[n] / ((len(nodes) - 1) * (len(nodes) - 2))) < 1e-9 for n in nodes)


def test_betweenness_of_many_twins():
    """Few sources stand for all, with the scores of each."""
    hubs, leaves = [f"h{k}" for k in range(3)], [f"s{k:03d}" for k in range(40)]
    every = [(h, s, 0.7) for h in hubs for s in leaves]
    all_ = graph.brandes(every, [*hubs, *leaves], dict.fromkeys([*hubs, *leaves], 1))
    few = graph.brandes([("h0", "s000", 0.7)], ["h0", "s000"], {"h0": 3, "s000": 40})
    assert all(abs(all_[n] - few[n[0] + ("0" if n[0] == "h" else "000")]) < 1e-9 for n in [*hubs, *leaves])


def test_components_and_communities(spark):
    clique = lambda names: list(itertools.combinations(names, 2))
    edges = clique("abcd") + clique("efgh") + [("d", "e")] + clique("xyz")
    df = spark.createDataFrame(edges, "x string, y string")
    assert {r.node: r.component for r in graph.components(df).collect()} == {**dict.fromkeys("abcdefgh", "a"), **dict.fromkeys("xyz", "x")}
    assert {r.node: r.community for r in graph.communities(df).collect()} == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("efgh", "e"), **dict.fromkeys("xyz", "x")}


def naive_communities(edges):
    near = {n: {} for e in edges for n in e}
    for x, y in edges:
        near[x][y] = near[y][x] = 1
    m, member, a = len(edges), {n: {n} for n in near}, {n: len(near[n]) / (2 * len(edges)) for n in near}
    while pairs := [(-2 * (near[i][j] / (2 * m) - a[i] * a[j]), i, j) for i in near for j in near[i] if i < j]:
        g, i, j = min(pairs)
        if g >= 0:
            break
        member[i] |= member.pop(j)
        a[i] += a.pop(j)
        for k, n in near.pop(j).items():
            del near[k][j]
            if k != i:
                near[i][k] = near[k][i] = near[i].get(k, 0) + n
    return {n: min(c) for c in member.values() for n in c}


def blown_up(rng, sizes, density):
    """Edges between groups of nodes, all or none of two groups, and a few edges fewer."""
    names = [f"n{k:02d}" for k in range(sum(sizes))]
    rng.shuffle(names)
    groups = [[names.pop() for _ in range(n)] for n in sizes]
    edges = [tuple(sorted((u, v))) for a, b in itertools.combinations(groups, 2) if rng.random() < density for u in a for v in b]
    return edges[: len(edges) - rng.randrange(3)]


def test_communities_of_twins():
    rng = random.Random(7)
    for _ in range(200):
        edges = blown_up(rng, [rng.choice([1, 1, 2, 5]) for _ in range(rng.randint(3, 7))], rng.choice([0.3, 0.6, 0.9]))
        near = {n: frozenset(y for e in edges if n in e for y in e if y != n) for e in edges for n in e}
        first = {n: min(k for k in near if near[k] == near[n]) for n in near}
        members = {c: [n for n in near if first[n] == c] for c in set(first.values())}
        few = [(x, y, 1) for x, y in edges if x in members and y in members]
        assert not edges or graph.greedy_communities(few, len(edges), members) == naive_communities(edges)


def test_few_edges_stand_for_those_of_all_twins(spark):
    edges = [(f"hub{h}", f"s{k:04d}") for h in range(4) for k in range(500) if (h, k) != (3, 7)] + [("far", "near")]
    df = spark.createDataFrame(edges, "x string, y string").withColumn("w", F.lit(1.0))
    twin = graph.twins(df, "w")
    got = {r.node: r.twin for r in twin.collect()}
    assert got == {**{f"s{k:04d}": "s0000" for k in range(500)}, "s0007": "s0007", **{f"hub{h}": "hub0" for h in range(3)}, "hub3": "hub3", "far": "far", "near": "near"}
    assert {(r.x, r.y) for r in graph.among_first(df, twin).collect()} == {("hub0", "s0000"), ("hub0", "s0007"), ("hub3", "s0000"), ("far", "near")}
    assert {r.node: r.community for r in graph.communities(df.select("x", "y")).collect()} == naive_communities(edges)


def test_closure_with_a_loop(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")], "child string, parent string")
    got = {(r.child, r.parent) for r in graph.closure(df).collect()}
    assert got == {(x, y) for x in "abcd" for y in "bcd"}


def test_duplicate_names_of_an_empty_table(spark):
    assert fuzzy.duplicate_names(spark.createDataFrame([], "name string")).collect() == []


def test_diff_is_one_aggregation(spark):
    """Repeats count once, nulls are alike, and each side is read once."""
    old = spark.createDataFrame([("a", "p", "x"), ("a", "p", "x"), ("b", "p", None), ("c", "p", "z"), ("c", "p", None)], "s string, p string, o string")
    new = spark.createDataFrame([("b", "p", None), ("c", "p", "y"), ("c", "p", "y"), ("c", "p", "z")], "s string, p string, o string")
    found = ontology.diff(old, new)
    assert sorted((r.s, r.o or "-", r.change) for r in found.collect()) == [("a", "x", "removed"), ("c", "-", "removed"), ("c", "y", "added")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Generate" not in plan


def test_rows_of_a_supplier_meet_before_names_are_distinct(spark, tmp_path):
    """Two suppliers of one name and two parts of one name are one triple; keys are not made distinct."""
    tables = {"region": "SELECT 0 AS r_regionkey, 'R' AS r_name", "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey", "supplier": "SELECT id AS s_suppkey, concat('S', id % 2) AS s_name, 0 AS s_nationkey FROM range(4)", "part": "SELECT id AS p_partkey, concat('P', id % 3) AS p_name FROM range(6)", "lineitem": "SELECT id % 5 AS l_suppkey, id % 7 AS l_partkey FROM range(70)"}
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = bindings.triples(spark, str(tmp_path))
    assert sorted((r.s, r.o) for r in found.filter("p = 'supplies'").collect()) == [(f"S{s}", f"P{p}") for s in range(2) for p in range(3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "RepartitionByExpression [l_suppkey" in plan
