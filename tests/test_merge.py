"""Closed-form merge against a sequential fold on random mentions."""

import random

from metaloom.operators import merge

SCHEMA = "seq bigint, source string, name string, eid string, conf double, definition string"


def sequential(rows):
    by_name, by_id, keys = {}, {}, {}
    for seq, _, name, eid, *_ in rows:
        if eid is None:
            key = name
        elif eid in by_id:
            key = by_id[eid]
        else:
            key = name if by_name.get(name) in (None, eid) else f"{name}#id:{eid}"
            by_id[eid] = key
            by_name[name] = by_name.get(name) or eid
        keys[seq] = key
    return keys


def folded(rows, priority):
    state, log = None, []
    for _, source, _, _, conf, value in rows:
        if state is None or state[0] == source:
            state = (source, conf, value)
        elif state[2].strip().lower() == value.strip().lower():
            continue
        else:
            ranks = [priority.index(s) if s in priority else None for s in (state[0], source)]
            if None not in ranks and ranks[0] != ranks[1]:
                keep, why = ranks[0] < ranks[1], "priority"
            else:
                keep, why = state[1] > conf, "confidence" if state[1] != conf else "recency"
            log.append(((source, conf, value) if keep else state, why))
            state = state if keep else (source, conf, value)
    return state, log


def mentions(rng, names=4):
    n = rng.randint(1, 12)
    sources = sorted(rng.choice("ABCD") for _ in range(n))
    return [(i, sources[i], rng.choice("pqrs"[:names]), rng.choice([None, None, "1", "2", "3"]), rng.choice([0.5, 0.9]), rng.choice(["x", " X", "y", "z"])) for i in range(n)]


def test_identity_is_the_sequential_one(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for case in range(120):
        own = mentions(rng)
        for seq, key in sequential(own).items():
            want[case * 100 + seq] = f"{case} {key.replace('#id:', f'#id:{case}.')}"
        rows += [(case * 100 + s, a, f"{case}_{n}", None if e is None else f"{case}.{e}", c, d) for s, a, n, e, c, d in own]
    random.Random(2).shuffle(rows)
    got = {r.seq: r.element_key for r in merge.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_fold_is_the_sequential_one(spark):
    rng = random.Random(3)
    cases = {f"k{i}": mentions(rng) for i in range(150)}
    rows = [(s, a, k, None, c, d) for k, own in cases.items() for s, a, _, _, c, d in own]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("name", "element_key")
    for priority in (["A", "B", "C", "D"], ["B", "A"], []):
        got = {r.element_key: r for r in merge.fold_field(df, "definition", priority or ["-"]).collect()}
        for k, own in cases.items():
            state, log = folded(own, priority)
            assert (got[k].source, got[k].conf, got[k].value) == state
            assert [((c.source, c.conf, c.value), c.resolution) for c in got[k].conflicts] == log
    fast = {r.element_key: r for r in merge.fold_in_passes(df, "definition").collect()}
    for k, own in cases.items():
        state, log = folded(own, ["A", "B", "C", "D"])
        assert (fast[k].source, fast[k].conf, fast[k].value, fast[k].conflicts) == (*state, len(log))
