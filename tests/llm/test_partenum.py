"""PartEnum join against brute force over all pairs."""

import random
from itertools import combinations

import pytest

from metaloom.llm import partenum

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    rows, texts = [], []
    for i in range(120):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts[-12:]).split()
            for _ in range(rng.randint(0, max(1, len(words) // 8))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60, 150]))]
        texts.append(" ".join(words))
        rows.append((i, texts[-1]))
    return rows


def features(text, n):
    words = (text or "").split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, threshold):
    """doc_id: (class_id, links) by comparing all pairs of texts."""
    sets = [(d, features(t, n)) for d, t in dict.fromkeys(rows) if d is not None]
    links, root = {d: 0 for d, _ in sets}, {d: d for d, _ in sets}

    def top(d):
        return d if root[d] == d else top(root[d])

    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and x and y and len(x & y) / len(x | y) >= threshold - 1e-12:
            links[a] += 1
            links[b] += 1
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    return {d: (top(d), links[d]) for d in links}


def found(df, n=partenum.N, threshold=partenum.THRESHOLD):
    got = partenum.similar_documents(df, n, threshold).collect()
    out = {r.doc_id: (r.class_id, r.links) for r in got}
    assert len(out) == len(got)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("n,threshold,seed", [(1, 0.8, 1), (2, 0.6, 2), (3, 0.6, 3), (3, 0.5, 6), (3, 1.0, 4)])
def test_all_pairs(spark, n, threshold, seed):
    rows = corpus(seed)
    got = found(frame(spark, rows), n, threshold)
    assert got == brute(rows, n, threshold) and any(links for _, links in got.values())


@pytest.mark.parametrize("features_a_task,together", [(partenum.TASK_FEATURES, partenum._LISTED), (1500, 3), (400, 24)])
def test_many_variants_meet_at_hubs(spark, monkeypatch, features_a_task, together):
    """Also where a task is cut into blocks, and where products take the place of lists."""
    monkeypatch.setattr(partenum, "TASK_FEATURES", features_a_task)
    monkeypatch.setattr(partenum, "_LISTED", together)
    monkeypatch.setattr(partenum, "GATHERING", 4)
    rng = random.Random(5)
    rows = []
    for base in range(3):
        for i in range(50):
            words = [f"v{base}_{j}" for j in range(80)]
            for _ in range(rng.randint(0, 14)):
                words[rng.randrange(80)] = f"x{rng.randrange(500)}"
            rows.append((base * 100 + i, " ".join(words)))
    rows += [(400 + i, rows[i][1]) for i in range(20)]  # copies
    assert found(frame(spark, rows)) == brute(rows, partenum.N, partenum.THRESHOLD)


def test_short_ids_that_meet_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(partenum, "SHORT_BITS", 6)
    rows = corpus(8)
    assert found(frame(spark, rows)) == brute(rows, partenum.N, partenum.THRESHOLD)


def test_packed_signatures_come_back():
    import numpy as np

    rng = np.random.default_rng(1)
    for sets in (3, 5000):
        sig, ids = rng.integers(0, 1 << 63, 6000).astype(np.uint64), rng.integers(0, 1 << 40, sets).astype(np.uint64)[rng.integers(0, sets, 6000)]
        batch = partenum._pack(sig, ids, 7)
        got = [(b, int(x), int(y)) for i, b in enumerate(batch.column(0).to_pylist()) for s, t in partenum._unpack(batch.slice(i, 1)) for x, y in zip(s, t)]
        assert sorted(got) == sorted(((int(s) >> 32) % 7, int(s) & 0xFFFFFFFF, int(i)) for s, i in zip(sig, ids))


def test_nulls_empties_copies_and_extra_columns(spark):
    long = " ".join(f"a{i}" for i in range(30_000))
    rows = [(1, "x y z", 0.5), (2, "x y z", None), (2, "x y z", None), (3, None, 1.0), (4, "", 1.0), (5, " \n\t", 1.0), (None, "x y z", 1.0), (6, "z y x", 1.0), (7, long, 1.0), (8, long + " tail", 1.0), (9, "x y", 0.0), (10, "x y", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, links double").selectExpr("*", "1 AS set_id", "2 AS task", "3 AS class_id", "4 AS doc")
    want = {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 1), 8: (7, 1), 9: (9, 1), 10: (9, 1)}
    assert found(df) == want
    gone = {r.doc_id: r.keeper for r in partenum.duplicates(df).collect()}
    assert gone == {2: 1, 8: 7, 10: 9}


def test_repeated_rows_and_a_document_with_two_texts(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "pq")
    rows = [(5, one), (5, one), (3, one + " end"), (3, one + " end"), (5, two), (9, two + " end"), (9, two + " end"), (11, two)]
    assert found(frame(spark, rows)) == {5: (3, 3), 3: (3, 1), 9: (3, 2), 11: (3, 2)}


def test_pairs_at_the_threshold_are_links(spark):
    a, b = "a b c d e f g h".split(), "a b c d e f x y z w".split()
    rows = [(1, " ".join(a)), (2, " ".join(b))]  # words: 6 of 12
    assert found(frame(spark, rows), 1, 0.5) == {1: (1, 1), 2: (1, 1)}
    assert found(frame(spark, rows), 1, 0.51) == {1: (1, 0), 2: (2, 0)}


def test_words_that_only_a_weak_hash_confuses_are_no_copies(spark):
    morse = ["ab"[bin(i).count("1") & 1] for i in range(2048)]
    x, y = "".join(morse), "".join("ba"[c == "b"] for c in morse)
    rows = [(1, x), (2, y), (3, x + " the end of it"), (4, y + " the end of it")]
    assert all(links == 0 for _, links in found(frame(spark, rows)).values())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert partenum.similar_documents(df).collect() == []
    assert partenum.duplicates(df).collect() == []


def test_sql_says_the_same(spark, tmp_path):
    import duckdb

    rows = corpus(9) + [(500, None), (501, ""), (502, "!!! ???"), (503, "??? !!!"), (504, "„Wort eins, zwei…“"), (505, "wort EINS (zwei)")]
    frame(spark, rows).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {d: (c, n) for d, c, n in con.execute(partenum.ORACLE_SQL).fetchall()}
    assert found(spark.read.parquet(f"{tmp_path}/d")) == want and want[505] == (504, 1)


def test_groups_follow_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "x bigint, y bigint")
    roots = {r.node: r.root for r in partenum.components(edges).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 90, 95: 90, 90: 90}


def test_case_and_edge_punctuation_are_no_other_words(spark):
    plain = [f"wort{i} über{i}" for i in range(10)]
    edited = [f"„Wort{i}, (ÜBER{i})…" for i in range(10)]
    rows = [(1, " ".join(plain)), (2, " ".join(edited)), (3, "!!! ???"), (4, "!!! ???"), (5, "wort0 wort-1")]
    assert found(frame(spark, rows)) == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0)}


def test_a_copy_with_two_edited_words_of_forty_is_found(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:12], "x", *words[13:30], "y", *words[31:]]))]
    assert found(frame(spark, rows)) == {1: (1, 1), 2: (1, 1)}


@pytest.mark.parametrize("size", [10, 30, 100, 400])
def test_sets_without_a_common_feature_share_no_signature(size):
    """Parts without features are the same everywhere; sent, they gather all sets of a size."""
    import numpy as np

    from metaloom.llm.bytesvec import slices

    texts = [" ".join(f"w{i}_{j}" for j in range(size + 2)) for i in range(200)]
    sets = partenum.Sets(next(iter(slices(partenum.pa.array(texts), 1 << 22))), 3)
    sig, row = partenum.signatures(sets, partenum.Bands(0.6, 500), np.full(1 << partenum.SKETCH_BITS, 100, np.int16))
    assert len(np.unique(sig)) == len(sig)


def test_rows_meet_at_the_least_common_hub():
    import numpy as np

    rng = np.random.default_rng(4)
    n, hubs = 60, 150
    has = {(int(r), int(h)): bool(w) for r, h, w in zip(rng.integers(0, n, 1500), rng.integers(0, hubs, 1500), rng.random(1500) < 0.6)}
    own = np.where(np.arange(n) % 3, hubs, np.arange(n) * 2)
    has |= {(r, int(own[r])): True for r in range(n) if own[r] < hubs}
    row, hub = (np.array(x) for x in zip(*has))
    meetings = partenum._Meetings(row, hub, np.array(list(has.values())), own, hubs)
    a, b = (np.array(x) for x in zip(*combinations(range(n), 2)))
    both = lambda x, y, h: (x, h) in has and (y, h) in has and (has[x, h] and has[y, h] or h in (own[x], own[y]))
    want = [min((h for h in range(hubs) if both(x, y, h)), default=hubs) for x, y in zip(a.tolist(), b.tolist())]
    assert meetings.listed(a, b, chunk=50).tolist() == want == meetings.among(np.arange(n))(a, b).tolist()


def kept(df, n=partenum.N, threshold=partenum.THRESHOLD):
    got = partenum.duplicates(df, n, threshold).collect()
    out = {r.doc_id: r.keeper for r in got}
    assert len(out) == len(got)
    return out


def expected(rows, n=partenum.N, threshold=partenum.THRESHOLD):
    return {d: c for d, (c, _) in brute(rows, n, threshold).items() if d != c}


@pytest.mark.parametrize("n,threshold,seed", [(1, 0.8, 1), (2, 0.6, 2), (3, 0.6, 3), (3, 0.5, 6), (3, 1.0, 4), (1, 0.1, 5)])
def test_duplicates_are_those_of_all_pairs(spark, n, threshold, seed):
    rows = corpus(seed)
    assert kept(frame(spark, rows), n, threshold) == expected(rows, n, threshold) != {}


@pytest.mark.parametrize("features_a_task,together", [(partenum.TASK_FEATURES, partenum._LISTED), (1500, 3), (400, 24)])
def test_duplicates_at_hubs(spark, monkeypatch, features_a_task, together):
    monkeypatch.setattr(partenum, "TASK_FEATURES", features_a_task)
    monkeypatch.setattr(partenum, "_LISTED", together)
    monkeypatch.setattr(partenum, "GATHERING", 4)
    monkeypatch.setattr(partenum, "_COUNTED", 500)
    rng = random.Random(5)
    rows = []
    for base in range(3):
        for i in range(50):
            words = [f"v{base}_{j}" for j in range(80)]
            for _ in range(rng.randint(0, 24)):
                words[rng.randrange(80)] = f"x{rng.randrange(500)}"
            rows.append((base * 100 + i, " ".join(words)))
    assert kept(frame(spark, rows)) == expected(rows)


@pytest.mark.parametrize("fine", [True, False])
def test_words_that_some_share_list_no_pairs_where_rarer_ones_suffice(spark, fine):
    """Signatures of duplicates; those of several features to a part have to send some of these words."""
    rng = random.Random(7)
    docs = frame(spark, [(i, " ".join([f"own{i}_{j}" for j in range(75)] + rng.sample([f"pool{j}" for j in range(400)], 85))) for i in range(60)])
    seen, _, sets = partenum._grouped(docs, 1, 0, fine)
    assert partenum._met(docs, 1, 0, 0.6, seen, sets, 4, fine).isEmpty() == fine
    assert kept(docs, 1) == {}


def test_counters_of_features_give_their_information(spark):
    import numpy as np

    from metaloom.llm.bytesvec import slices

    docs = frame(spark, [(i, " ".join(["all", f"half{i % 2}", f"own{i}"])) for i in range(64)])
    seen, _, sets = partenum._grouped(docs, 1, 0, True)
    info = partenum._fine_information(seen, 64)
    words = partenum.Sets(next(iter(slices(partenum.pa.array(["all", "half0", "half1", "own7"]), 1 << 22))), 1)
    assert info[(words.mixed >> np.uint64(64 - partenum.FINE_BITS)).astype(np.int64)].tolist() == [0, 8, 8, 48]


def test_blocks_that_hang_together_are_left_out():
    import numpy as np

    from metaloom.llm.bytesvec import united

    m, width = 2500, 12  # three blocks
    features = np.tile(np.arange(width, dtype=np.uint64), m)
    group, seen = np.arange(m), 0
    for p, q in partenum.gathered(features, np.arange(m + 1) * width, np.arange(m), 0.6, lambda: group):
        seen += 1
        group = united(group, p, q)
    assert (group == 0).all() and seen == 3  # of the first block with each; all six pairs of blocks before
