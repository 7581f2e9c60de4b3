import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spanlab.llm import bpe, lengths

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=40))
def test_word_merges(text):
    assert [i for w in __import__("regex").findall(P.PATTERN, text) for i in bpe.encode_word(w.encode(), RANKS)] \
        == ENCODING.encode_ordinary(text)


def test_long_word():
    for word in ("a" * 5000, " " * 3000 + "x", "=-" * 2000, "é" * 999):
        assert bpe.encode_word(word.encode(), RANKS) == ENCODING._encode_bytes(word.encode()) or \
            bpe.encode_word(word.encode(), RANKS) == ENCODING.encode_single_piece(word)


def test_odd_documents_and_small_blocks(odd_docs):
    out = bpe.decode(bpe.encode(odd_docs, PATH, P.PATTERN, block_bytes=200, buckets=7), PATH).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    want = sorted((r.doc_id is not None, r.doc_id or 0, ENCODING.encode_ordinary(r.text or ""), (r.text or "").encode())
                  for r in odd_docs.collect())
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.tokens, bytes(r.decoded)) for r in out)
    assert got == want and len(texts) == len(out)


def test_digests(spark):
    text = "It's 'quoted' text\n\n  with  spaces, ümläute, 數字 and 🙂.<|endoftext|>"
    row = bpe.encode_digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, P.PATTERN).first()
    ids = ENCODING.encode_ordinary(text)
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_no_documents(no_docs):
    assert bpe.encode(no_docs, PATH, P.PATTERN).collect() == []


def test_unknown_id_raises(spark):
    with pytest.raises(Exception, match="token-byte table"):
        bpe.decode(spark.createDataFrame([([60000],)], "tokens array<int>"), PATH).collect()


def test_vocabulary_bound(tmp_path, monkeypatch):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    assert bpe.load_ranks(str(path)) == {b"a": 0}
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 1)
    with pytest.raises(ValueError):
        bpe.load_ranks(str(path))


def test_pack_round_trip():
    import numpy as np
    for a in ([], [0], [1, 70000, 3], list(range(1000))):
        assert bpe.unpack(bpe.pack(np.array(a, np.uint32))).tolist() == a
    words = [b"", b"x", b"\xff\x00", b"long" * 50]
    assert bpe.unpack_words(bpe.pack_words(words)) == words
    assert bpe.unpack_words(bpe.pack_words([])) == []


def test_length_histogram(spark):
    n = [0, 0, 3, 3, 3, 5, 9000, 9000, 20000, None]
    sums = lengths.suffix_sums(lengths.histogram(
        spark.createDataFrame([(x,) for x in n], "n_tokens long")), bucket=4).cache()
    known = sorted(x for x in n if x is not None)
    for r in sums.collect():
        L = r.length
        assert r.n_docs == known.count(L)
        assert r.docs_at_least == sum(x >= L for x in known)
        assert r.tokens_at_least == sum(x for x in known if x >= L)
        assert r.docs_up_to == sum(x <= L for x in known)
        assert r.truncated_total == sum(min(x, L) for x in known)
    for limit in (0, 1, 4, 9000, 10**7):
        assert lengths.truncated_total(sums, limit) == sum(min(x, limit) for x in known)
    assert lengths.quantile(sums, 0.5) == 3 and lengths.quantile(sums, 1.0) == 20000
    empty = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([], "n_tokens long")))
    assert empty.collect() == [] and lengths.truncated_total(empty, 5) == 0
