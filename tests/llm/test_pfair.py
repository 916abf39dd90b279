"""Pfair mixing against a slot-by-slot simulation."""

from collections import Counter
from fractions import Fraction

import pytest

from metaloom.llm import pfair
from tests.llm.helpers import DOCS, awkward, empty


def simulate(blocks, weights):
    """Earliest deadline first over all blocks, one slot at a time."""
    left, done, out = {s: n for s, n in blocks.items() if n}, Counter(), []
    while left:
        active = [s for s in left if weights.get(s, 0) > 0] or list(left)
        share = {s: max(1, weights.get(s, 0)) for s in active}
        total, phase, t = sum(share.values()), Counter(), 0
        order = sorted(active, key=lambda s: (s is None, s or ""))
        while all(left.get(s) for s in active):
            ready = [s for s in order if phase[s] * total // share[s] <= t]
            s = min(ready, key=lambda s: (-(-(phase[s] + 1) * total // share[s]), order.index(s)))
            out.append((s, done[s]))
            done[s] += 1
            phase[s] += 1
            left[s] -= 1
            t += 1
            assert all(abs(phase[x] - Fraction(t * share[x], total)) < 1 for x in active)
        left = {s: n for s, n in left.items() if n}
    return out


CASES = [({"a": 40, "b": 13, "c": 5}, {"a": 3, "b": 2, "c": 1}), ({"a": 5, "b": 50, None: 9}, {"a": 7, "b": 1, None: 4}), ({"a": 3, "b": 4}, {"a": 2}), ({"x": 1}, {"x": 1000}), ({"a": 30, "b": 30, "c": 30}, {"a": 1, "b": 1, "c": 1})]


@pytest.mark.parametrize("blocks,weights", CASES)
def test_closed_form_is_the_simulation(spark, blocks, weights):
    rows = [(100 * n + i, "t", "en", s, 1) for n, (s, k) in enumerate(blocks.items()) for i in range(2 * k)]
    got = pfair.schedule(spark.createDataFrame(rows, DOCS), weights, block_docs=2).collect()
    by_slot = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        by_slot.setdefault(r.slot, set()).add((r.source, r.block))
    assert [by_slot[t] for t in range(len(by_slot))] == [{x} for x in simulate(blocks, weights)]
    assert sorted(r.position for r in got) == list(range(len(rows)))


def test_default_weights_follow_square_roots():
    w = pfair.default_weights({"a": 10_000, "b": 100})
    assert w == {"a": 909, "b": 91}


def test_mixed_keeps_every_row(spark):
    df = awkward(spark)
    out = pfair.mixed(df, block_docs=2)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert pfair.mixed(empty(spark)).collect() == [] and pfair.schedule(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        pfair.schedule(df, {"a": -1})


def test_mixed_is_in_the_order_of_the_schedule(spark):
    rows = [(i, f"t{i}", "en", "s" + str(i % 3), 1) for i in range(90)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    place = {r.doc_id: r.position for r in pfair.schedule(df, block_docs=4).collect()}
    assert [r.doc_id for r in pfair.mixed(df, block_docs=4).collect()] == sorted(place, key=place.get)


def test_many_rows_without_an_id_take_linear_time(spark):
    """They are one another's equals in every key; all of them keep their row."""
    df = spark.range(200_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat('t', id) AS text", "'en' AS lang", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source", "id AS n_chars")
    out = pfair.mixed(df)
    assert out.selectExpr("count(*)", "count(DISTINCT n_chars)").first() == (200_000, 200_000)
    places = pfair.schedule(df).selectExpr("count(*)", "count(DISTINCT position)").first()
    assert places == (200_000, 200_000)


def test_repeated_ids_and_clashing_names(spark):
    rows = [(1, f"t{i % 4}", "en", "a", 1) for i in range(12)] + [(2, "x", "en", "b", 1)] * 5
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS h", "2 AS own", "3 AS part", "4 AS row", "5 AS position", "6 AS slot", "7 AS phase", "8 AS s", "9 AS p", "10 AS before", "11 AS j_from", "12 AS __source")
    out = pfair.mixed(df, block_docs=3)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
