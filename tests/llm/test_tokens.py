"""Operators 2, 3 and 7 against the tokenizer itself."""

import pytest
from tokenizers import Tokenizer

from metaloom.llm import bpe, tokencount, tokenout
from tests.llm.helpers import LONG, awkward, empty

TRICKY = ["a  b\n\n c", "naïve café — déjà", "\U0001f600\U0001f468‍\U0001f469 ok", "<|endoftext|> is text", "tab\tand\r\nreturn", "１２３ 45 6,789.0", " 　x ", "x" * 3000, "it's we'll THEY'RE", "語 文 \n字"]


def direct(texts):
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    tok.encode_special_tokens = True
    return [tok.encode(t, add_special_tokens=False) for t in texts]


def test_ids_offsets_and_round_trip(spark):
    texts = [*TRICKY, LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in bpe.encode_documents(df).collect()}
    for i, e in enumerate(direct(texts)):
        assert got[i].ids == e.ids
        assert got[i].exact and got[i].n_tokens == len(e.ids)
        assert all(0 <= a < b <= len(texts[i]) for a, b in zip(got[i].starts, got[i].ends))
        # spans leave no gap: each begins where the one before ends, or shares its split character
        assert all(b in (a, a - 1) for a, b in zip(got[i].ends, got[i].starts[1:]))
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(df)).collect()}
    assert [back[i] for i in range(len(texts))] == texts


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = bpe.encode_documents(df).collect()
    assert len(rows) == df.count() and all(r.exact for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert bpe.encode_documents(empty(spark)).collect() == []
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode_documents(spark.createDataFrame([(1, [10**7])], "doc_id bigint, ids array<int>")).collect()


def test_sections_add_up(spark):
    texts = [*TRICKY, "one line\nand two\n\nfour"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sections = tokencount.count_sections(df).collect()
    for i, e in enumerate(direct(texts)):
        mine = sorted((r.section, r.start_char, r.end_char, r.n_tokens) for r in sections if r.doc_id == i)
        assert sum(m[3] for m in mine) == len(e.ids)
        assert [texts[i][a:b] for _, a, b, _ in mine] == texts[i].splitlines(keepends=True) or "\r" in texts[i] or "\n" not in texts[i]
        brute = [0] * len(mine)
        for a, b in e.offsets:
            share = [max(0, min(b, y) - max(a, x)) for _, x, y, _ in mine]
            brute[share.index(max(share))] += 1
        assert [m[3] for m in mine] == brute


def test_sections_of_awkward_rows(spark):
    df = awkward(spark)
    rows = tokencount.count_sections(df).collect()
    assert [(r.section, r.n_tokens) for r in rows if r.doc_id == 2] == [(0, 0)]
    assert len([r for r in rows if r.doc_id == 1]) == 4
    assert tokencount.count_sections(empty(spark)).collect() == []
    fields = tokencount.count_fields(df, "doc_id", ["source", "text"]).collect()
    assert len(fields) == 2 * df.count()


def test_frames_decode_alone(spark, tmp_path):
    many = [(i, f"document {i} about tokens and frames " * (i % 7 + 1)) for i in range(60)] + [(100, None), (101, ""), (102, LONG)]
    df = spark.createDataFrame(many, "doc_id bigint, text string")
    frames = tokenout.encode_frames(df)
    rows = frames.collect()
    dictionary = next(r.frame for r in rows if r.kind == "dictionary")
    assert len(dictionary) > 0 and len({r.dict_hash for r in rows}) == 1
    ids = {r.doc_id: r.ids for r in tokenout.decode_frames(frames, bytes(dictionary)).collect()}
    back = {r.doc_id: r.text for r in bpe.decode_documents(spark.createDataFrame([(k, v) for k, v in ids.items() if v is not None], "doc_id bigint, ids array<int>"), None).collect()}
    assert ids[100] is None and ids[101] == [] and {k: v for k, v in many if v is not None} == back
    folder = f"file://{tmp_path}/shards"
    tokenout.write_shards(df, folder)
    some = tokenout.read_documents(spark, folder, [3, 102, 101, 999])
    assert some == {3: ids[3], 102: ids[102], 101: []}


def test_frames_hold_the_library_s_ids(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(bpe.tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TRICKY, LONG, *morse(2048)]
    frames = tokenout.encode_frames(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    dictionary = next(bytes(r.frame) for r in frames.collect() if r.kind == "dictionary")
    got = {r.doc_id: r.ids for r in tokenout.decode_frames(frames, dictionary).collect()}
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t) for t in texts]


def morse(n):
    """Two texts that a polynomial modulo 2**64 can't tell apart."""
    one = ["ab"[bin(i).count("1") & 1] for i in range(n)]
    return "".join(one), "".join("ba"[c == "b"] for c in one)


def test_runs_that_only_a_weak_hash_confuses(spark):
    texts = morse(2048)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.encode_documents(df).collect()}
    assert [got[i].ids for i in (0, 1)] == [e.ids for e in direct(texts)] and all(r.exact for r in got.values())
    assert {r.doc_id: r.n_tokens for r in tokencount.count_sections(df).collect()} == {i: len(e.ids) for i, e in enumerate(direct(texts))}


def test_runs_that_meet_in_one_hash_get_their_own_ids(monkeypatch):
    """Even where all hashes are equal."""
    import numpy as np
    import pyarrow as pa

    from metaloom.llm.bytesvec import slices

    monkeypatch.setattr(bpe, "span_hash", lambda data, start, end: np.full(len(start), 7, np.uint64))
    enc = bpe.RunEncoder(bpe.tokenizer_path())
    texts = ["some words here", "other words there", ""]
    ids, count = enc.encode(next(slices(pa.array(texts))))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [e.ids for e in direct(texts)]


def test_the_dictionary_is_trained_on_all_documents(spark, monkeypatch):
    """Also where it takes several steps: without the last documents it is another."""
    rows = [(i, f"document {i} about tokens and frames, number {i * i} " * 5 + ("zyxw vutsrq ponml kjihg fedcba " * 6 if i >= 700 else "")) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(8, "doc_id")
    monkeypatch.setattr(tokenout, "TRAIN_BYTES", 16_000)
    monkeypatch.setattr(tokenout, "FAN_IN", 4)
    path = bpe.tokenizer_path("byte_bpe_50k.tiktoken")
    whole, part = (tokenout.train_dictionary(x, path, dict_bytes=2048) for x in (df, df.filter("doc_id < 700")))
    assert whole != part and 256 <= len(part) <= 2048 and 256 <= len(whole) <= 2048
    got = {r.doc_id: r.n_tokens for r in tokenout.encode_frames(df, path, whole).collect()}
    assert len(got) == 801


def test_frames_of_awkward_and_empty_tables(spark):
    rows = tokenout.encode_frames(awkward(spark)).collect()
    assert len(rows) == 10 and all(r.frame is None for r in rows if r.doc_id == 2)
    assert [r.kind for r in tokenout.encode_frames(empty(spark)).collect()] == ["dictionary"]
