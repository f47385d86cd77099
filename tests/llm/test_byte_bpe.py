"""Byte-level BPE against the tiktoken library, which reads the same rank file."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from shelfspark.llm import byte_bpe
from shelfspark.llm.queries import op13_byte_bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(FILE, P.PATTERN)


def test_texts_of_all_kinds(vocabulary, plain):
    dice, model = random.Random(7), vocabulary.model()
    tokens = [plain.decode_single_token_bytes(i) for i in range(0, 50_000, 7)]
    texts = ["", " ", "  \n", "<|endoftext|>", "naïve 東京 🙂🙂 é", "'s'll don't", "՘x ꟎ḃ0"]
    for k in range(3000):
        run = "".join(dice.choice("ab=-_ \n.*") * dice.randint(1, 40) for _ in range(4))
        mixed = b"".join(dice.choice(tokens) for _ in range(8)).decode("utf-8", "replace")
        repeat = (dice.choice(tokens) * dice.randint(1, 12)).decode("utf-8", "replace")
        texts.append((run, mixed, repeat)[k % 3])
    n, (ids,) = model.encode(texts)
    want = [plain.encode_ordinary(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_settled_characters_are_split_alike(vocabulary):
    model = vocabulary.model()
    for c in map(chr, [*range(0x530), *range(0x2000, 0x2070), *range(0x3030, 0x3100), *range(0x4E00, 0xA000, 5), *range(0xAC00, 0xD7B0, 5)]):
        text = f"a{c}a {c}1{c} {c}{c}  {c}."
        exact = [p for p, _ in model.split_exactly(text)]
        assert model.pieces(text) == exact, hex(ord(c))
        if not model.unsettled(text):
            assert model.split(text) == exact, hex(ord(c))


def test_long_texts_in_parts(spark, vocabulary, plain, monkeypatch):
    long = ("word " * 30 + "\n\n  x" + "abc" * 50 + " ünï ") * 40 + "z" * 5000
    model = vocabulary.model()
    monkeypatch.setattr(byte_bpe, "GROUP", 64)
    parts = list(model.parts(long))
    assert "".join(parts) == long and len(parts) > 100
    assert [i for p in parts for i in model.encode([p])[1][0].tolist()] == plain.encode_ordinary(long)
    million = spark.createDataFrame([(1, "x" * 1_000_000), (2, "lorem ipsum " * 150_000), (3, " " * 400_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(million, vocabulary), vocabulary).collect()}
    assert {k: len(bytes(r.decoded)) for k, r in got.items()} == {1: 1_000_000, 2: 1_800_000, 3: 400_000}
    assert got[2].ends[-1] == 1_800_000 and len(got[2].starts) == len(plain.encode_ordinary("lorem ipsum " * 150_000))


def test_rows_columns_and_offsets(spark, vocabulary, plain):
    texts = ["a 🙂 naïve", None, "", "same", "same", "é" * 3]
    df = spark.createDataFrame([(i if i < 4 else 3, t, [1], "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, decoded string, `a.b` string")
    out = byte_bpe.encode(df, vocabulary)
    assert out.columns == ["doc_id", "ids", "decoded", "a.b", "ids_", "starts", "ends"]
    rows = out.collect()
    assert sorted(r.ids_ for r in rows) == sorted(plain.encode_ordinary(t or "") for t in texts)
    for r in rows:
        text = plain.decode(r.ids_)
        for i, a, b in zip(r.ids_, r.starts, r.ends, strict=True):  # a token's bytes lie inside the characters it names
            assert plain.decode_single_token_bytes(i) in text[a:b].encode() and b > a
        assert {c for a, b in zip(r.starts, r.ends, strict=True) for c in range(a, b)} == set(range(len(text)))
    back = byte_bpe.decode(out, vocabulary, "ids_", as_text=True)
    assert sorted(bytes(r.decoded_) for r in back.collect()) == sorted((t or "").encode() for t in texts)
    assert byte_bpe.encode(df.limit(0), vocabulary).count() == 0


def test_split_characters_and_unknown_ids(spark, vocabulary, plain):
    smile = plain.encode_ordinary("🜲")
    assert len(smile) > 1  # the character lies in several tokens
    rows = [(1, smile), (2, smile[:1]), (3, None), (4, []), (5, [99_999_999, -1, None, smile[0]])]
    got = {r.k: (bytes(r.decoded), r.decoded_text) for r in byte_bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), vocabulary, as_text=True).collect()}
    assert got[1] == ("🜲".encode(), "🜲") and got[2][1] == "�" and got[2][0] == "🜲".encode()[: len(got[2][0])]
    assert got[3] == got[4] == (b"", "") and got[5][1] == "�" * 4


def test_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = plain.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    rows = op13_byte_bpe(spark, sf).collect()
    assert len(rows) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
