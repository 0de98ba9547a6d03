import random

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken

from trapline.llm import bpe
from trapline.llm.pieces import pieces

PATH = public.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, n_tokens int"
ODD = ["", " ", "  a  b \n\n c　d\xa0 e  ", "\n \n a's it'S don't 12345 !!! \t\t z ", "🙂🙂 é́ ẞ",
       "<|endoftext|> hi", "\x1c a \x85 b", "a b\0 c\0", " a", "a ", "." * 50, "ab" * 700, " " * 99,
       "x" * 2000, "ſt Ⅷ ½ ٣٤ नमस्ते 你好,世界"]


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(PATH),
                             special_tokens={})


def texts():
    rng = random.Random(2)
    letters = "abcde  ' .,!?\n\t019éß你🙂 -_"
    return ODD + ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(300)] + [
        " ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 14))) for _ in range(400))]


def test_equals_the_known_encoder_and_round_trips(spark, known):
    rows = list(enumerate(texts())) + [(None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    encoded = bpe.encode(docs, PATH, public.PATTERN)
    got = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids)) for r in encoded.collect())
    want = sorted((str(i), len(w), np.array(w, "<u4").tobytes()) for i, t in rows
                  for w in [known.encode_ordinary(t or "")])
    assert got == want
    back = sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe.decode(encoded, PATH).collect())
    assert back == sorted((str(i), (t or "").encode()) for i, t in rows)


def test_long_pre_tokens_are_merged_in_the_same_order(known, monkeypatch):
    """By the heap and by the matrices, also where parts of a token are later than the token."""
    rng = random.Random(9)
    table = bpe.table(PATH)
    tokens = [b"x" * 3000, b"ab" * 900, b"a" * 1025, "é🙂".encode() * 400] + [
        "".join(rng.choices(s, k=rng.randint(1025, 3000))).encode()
        for s in ("ab", "abc", "etaoinshr", "ABCDEFGHabcdefgh0123+/=", "éß你", ".-_=") for _ in range(4)]
    long = table.encode(tokens)
    monkeypatch.setattr(bpe, "LONG_ROW", 1 << 30)
    assert table.encode(tokens) == long
    short = [bytes(rng.choices(b"abcde. -", k=rng.randint(1, 40))) for _ in range(2000)]
    monkeypatch.setattr(bpe, "LONG_ROW", 0)
    heaped = table.encode(short)
    monkeypatch.setattr(bpe, "LONG_ROW", 1 << 30)
    assert heaped == table.encode(short)


def test_a_megabyte_of_letters(spark, known):
    import time
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    base64 = "".join(rng.choices("ABCDEFGHabcdefgh0123456789", k=1 << 17))
    docs = spark.createDataFrame([(1, text, "x", 1), (2, base64, "x", 1), (3, "z" * (1 << 18),
                                  "x", 1)], SCHEMA)
    started = time.time()
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist()
           for r in bpe.encode(docs, PATH, public.PATTERN).collect()}
    assert time.time() - started < 120
    assert got == {r.doc_id: known.encode_ordinary(r.text) for r in docs.collect()}


def test_pieces_end_where_pre_tokens_do(known):
    for text in texts():
        assert "".join(pieces(text)) == text
        whole = [i for p in pieces(text) for i in known.encode_ordinary(p)]
        assert whole == known.encode_ordinary(text)


def test_memory_of_pieces_is_bounded(known):
    memo = bpe.Memo(bpe.piece_encoder(PATH, public.PATTERN), limit=10)
    for text in texts()[:60]:
        assert np.frombuffer(memo([text])[0], "<u4").tolist() == known.encode_ordinary(text)
        assert len(memo.held) <= max(10, len(set(pieces(text))))


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(docs, PATH, public.PATTERN, digests=True).collect() == []
