"""BPE by the pair index against the tokenizers library and against merging by hand."""

import hashlib
import random

import numpy as np
import pytest
import regex

from shipyard.llm import bpe, queries

PATH = queries.tokenizer_path("byte_bpe_50k.json")
DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def by_hand(piece: bytes, v: bpe.Vocabulary) -> list[int]:
    """Merges the leftmost pair of least rank until none is left."""
    ids = [int(v.byte_id[b]) for b in piece]
    rank = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(v.left, v.right))}
    while True:
        found = min(((rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
        if found is None:
            return ids
        ids[found[1]:found[1] + 2] = [int(v.made[found[0]])]


def texts() -> list[str]:
    rnd = random.Random(3)
    kinds = ["abcdefgh ", "aab ", "'stre m", "éèüß x", " \n\t\r \xa0", "日本語テキスト 가", "0123²½ ", "<|endoftext|> a", "😀👍🏽é̂", "՘꟎₏ a1"]
    out = ["".join(rnd.choice(k) for _ in range(rnd.randrange(60))) for k in kinds for _ in range(12)]
    return out + ["", "a" * 5001, "ab" * 4000, "it's  we'll\n\n  I'D 'S", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "\x00\x1c\x85"]


def test_encoder_equals_library(library):
    enc = bpe.Encoder(PATH)
    ts = texts()
    got = enc.encode(ts)
    for t, x in zip(ts, got):
        want = library.encode(t, add_special_tokens=False).ids
        assert x.tolist() == want, repr(t)
        assert bpe.decode_ids(x, enc.v) == library.decode(want, skip_special_tokens=False)


def test_pieces_equal_merging_by_hand():
    v = bpe.vocabulary(PATH)
    rnd = random.Random(5)
    pieces = ["".join(rnd.choice("aeinrst h") for _ in range(rnd.randrange(1, 24))).encode() for _ in range(300)] + [b"aaaaaaa", b"aa", b"a"]
    ids, counts = bpe.encode_pieces(pieces, v)
    low = 0
    for p, n in zip(pieces, counts.tolist()):
        assert ids[low:low + n].tolist() == by_hand(p, v)
        low += n
    assert low == len(ids)


def test_settled_characters_split_alike():
    from tokenizers.pre_tokenizers import ByteLevel

    pre, cut = ByteLevel(add_prefix_space=False), regex.compile(bpe.PATTERN)
    settled = regex.compile(f"[{bpe.SETTLED}]")
    for c in filter(settled.fullmatch, map(chr, [*range(0xD800), *range(0xE000, 0x11000)])):
        s = f"a{c}1{c}{c}! x"
        assert [o for _, o in pre.pre_tokenize_str(s)] == [m.span() for m in cut.finditer(s)], hex(ord(c))


def test_forgetting_changes_nothing(monkeypatch):
    ts = texts()
    want = [x.tolist() for x in bpe.Encoder(PATH).encode(ts)]
    monkeypatch.setattr(bpe, "KNOWN_IDS", 5)
    enc = bpe.Encoder(PATH)
    assert [enc.encode([t])[0].tolist() for t in ts] == want


def test_decode_of_broken_ids(library):
    v = bpe.vocabulary(PATH)
    half = library.encode("é", add_special_tokens=False).ids + [int(v.byte_id[0xC3]), int(v.byte_id[0xE2]), int(v.byte_id[0x82])]
    assert bpe.decode_ids(np.array(half, np.uint32), v) == library.decode(half, skip_special_tokens=False)
    assert bpe.decode_ids(np.array([4_000_000_000], np.uint32), v) == ""


def test_round_trip_of_rows(spark, library):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "same"), (3, "same"), (4, "long " * 50_000), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids", "'x' as decoded", "2 as n_tokens")
    got = sorted((tuple(r) for r in bpe.round_trip(df, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(df.where("false"), PATH).count() == 0
    ids = {r.doc_id: r.ids for r in bpe.unpack(bpe.encode(df.where("doc_id = 5"), PATH)).collect()}
    assert ids == {5: [50256]}
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((str(i), t or "") for i, t in rows)


def test_query_equals_library(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet(DOCS).select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got
