import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from driftfield.llm import bpe, tokencount

MODEL, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: r for r, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})


@pytest.mark.parametrize("table", ["odd", "corpus", "none"])
def test_counts_match_library(request, table):
    df = request.getfixturevalue(table)
    got = tokencount.count_tokens(df, MODEL, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(SP.encode(r.text or "")), n > 100) for r in df.collect())
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁a<s>'b1\t"), st.characters(codec="utf-8")), max_size=40))
def test_pre_tokens_never_split_a_piece(text):
    assert tokencount.Lengths(MODEL, []).count(text) == len(SP.encode(text))


def test_frequent_table_is_exact(corpus):
    table = tokencount.frequent_pre_tokens(corpus.select("doc_id", "text"), MODEL, 50)
    length = tokencount.encoded_length(MODEL)
    assert len(table) == 50 and all(n == length(w) for w, n in table)


@pytest.mark.parametrize("table", ["odd", "corpus", "none"])
def test_bpe_matches_library_and_round_trips(request, table):
    df = request.getfixturevalue(table)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, RANKS, P.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in df.collect():
        ids = TIK.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert got == sorted(want)


def test_encode_then_decode(odd):
    ids = bpe.encode(odd, RANKS, P.PATTERN)
    back = sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe.decode(ids, RANKS, P.PATTERN).collect())
    assert back == sorted((str(r.doc_id), (r.text or "").encode()) for r in odd.collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n'ab1tes"), st.characters(codec="utf-8")), max_size=60))
def test_bpe_any_text(text):
    c = bpe.codec(RANKS, P.PATTERN)
    ids = c.encode(text)
    assert ids == ",".join(map(str, TIK.encode_ordinary(text))) and c.decode(ids) == text.encode()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.at) == list(range(5000))
    assert all(h.find(k) == i for i, k in enumerate(keys)) and h.find(b"absent") == -1 and bpe.PerfectHash([]).find(b"x") == -1


def test_memo_keeps_its_bound():
    c = bpe.Recent(lambda k: k * 2, 3000)
    words = [f"{i:04}" for i in range(100)]
    assert [c[w] for w in words] == [2 * w for w in words] and 5 <= len(c) + len(c.old) <= 3000 // 200
    assert c["x" * 2000] == "x" * 4000 and "x" * 2000 not in c
