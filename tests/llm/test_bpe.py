import hashlib
import random

import public_tokenizers as P
import tiktoken
from groundphrase.llm import bpe
from groundphrase.llm.queries import RANKS, op1_bpe
from groundphrase.sources import table

SF = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def own():
    raw = bpe.read_ranks(P.path(RANKS))
    return raw, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(raw), special_tokens={})


def test_query_against_tiktoken(spark):
    _, enc = own()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = op1_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def test_random_texts_and_a_small_state_bound():
    raw, enc = own()
    codec = bpe.Codec(raw, P.PATTERN)
    codec.pieces.machine.max_states = 50
    random.seed(2)
    parts = ["a", "b", "the", " ", "\n", "é", "漢", "😀", "'s", "1", "\t", "Ω", "##", " " * 7, "zz", "\x00", "</s>"]
    for _ in range(800):
        s = "".join(random.choice(parts) for _ in range(random.randint(0, 50)))
        assert list(codec.encode(s)) == enc.encode_ordinary(s)
        assert codec.decode(codec.encode(s)) == s
    for s in (" " * 5000, "a" * 3000, "ab" * 3000, "=-" * 2000):
        assert list(codec.encode(s)) == enc.encode_ordinary(s)


def test_utf8_stream_equals_whole_decoding():
    random.seed(3)
    pool = [0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0, 0xF4, 0x90, 0xE0]
    for _ in range(2000):
        b = bytes(random.choice(pool) for _ in range(random.randint(0, 12)))
        stream, out, i = bpe.Utf8Stream(), "", 0
        while i < len(b):
            j = i + random.randint(1, 3)
            out += stream.feed(b[i:j])
            i = j
        assert out + stream.close() == b.decode("utf-8", "replace")


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a\u0000b", 3), (4, "x y " * 100_000, 4)], "doc_id long, text string, tokens int")
    got = {r.doc_id: r for r in bpe.token_digests(docs, P.path(RANKS), P.PATTERN).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].ids_sha256 == sha(b"")
    assert got[None].decoded_sha256 == sha(b"a\x00b") and got[4].decoded_sha256 == sha(("x y " * 100_000).encode())
    out = bpe.encode(docs, P.path(RANKS), P.PATTERN, ids_col="t")
    assert out.columns == ["doc_id", "text", "tokens", "t"] and out.limit(0).count() == 0
    back = bpe.decode(out, P.path(RANKS), P.PATTERN, ids_col="t").collect()
    assert all((r.text or "") == r.decoded for r in back) and len(back) == 4
    assert bpe.encode(docs.limit(0), P.path(RANKS), P.PATTERN).count() == 0
