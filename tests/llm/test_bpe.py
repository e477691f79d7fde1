import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from holdfast.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.codec(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def texts():
    fixed = ["", " ", "   a  b\n\n c\t ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c", "<|endoftext|", "日本語テキスト 😀😀 é", "don't I'LL we've\x85 x", "a\x1c b\x1d  c\xa0 f  g", "à la carte à ", "x\r\n y"]
    fixed += ["a" * 30_000, "ab1 " * 20_000, " " * 5_000, "é" * 5_000, "\x00\x01"]
    rng = random.Random(5)
    sets = [[32, 9, 10, 0x1C, 0x85, 0xA0, 97, 98, 0x2028, 39, 115], [*range(32, 127)], [*range(1, 0x24F)], [*range(1, 0xD7FF)] + [*range(0x1F300, 0x1F600)]]
    return fixed + ["".join(chr(rng.choice(s)) for _ in range(rng.randrange(40))) for s in sets for _ in range(400)]


def test_equals_the_library_and_comes_back(own, theirs):
    for t in texts():
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t[:60]
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == t


def test_no_token_spans_a_certain_cut(own):
    for token in own.bytes_of.values():
        if token.decode("utf-8", "replace") not in own.special:
            assert not any(own.certain_cut[a << 8 | b] for a, b in zip(token, token[1:]))


def test_memory_starts_afresh(own, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    for t in ("one two three four", "five six seven eight nine ten", "one two three"):
        assert own.encode(t) == theirs.encode(t, add_special_tokens=False).ids


def test_tables(docs, theirs):
    vocabulary = bpe.read_vocabulary(PATH)
    got = {r["doc_id"]: r for r in bpe.encode(docs([(1, "some text"), (2, None), (3, "")]), vocabulary).collect()}
    assert got[1]["ids"] == theirs.encode("some text").ids and got[1]["decoded"] == "some text" and got[1]["n_tokens"] == 2
    assert got[2]["ids"] == got[3]["ids"] == [] and got[2]["decoded"] == ""
    digests = bpe.encode_digests(docs([(None, None), (1, "x"), (1, "x")]), vocabulary)
    assert [r["n_tokens"] for r in digests.orderBy("n_tokens").collect()] == [0, 1, 1]
    assert bpe.encode(docs([]), vocabulary).count() == 0


def test_parts_cover_a_batch():
    import pyarrow as pa

    from holdfast.llm import bpe

    sizes = [0, 10, bpe.PART_BYTES, 1, bpe.PART_BYTES * 2, 0, 0, bpe.PART_BYTES - 1, 1, 1]
    batch = pa.record_batch({"text": ["x" * n for n in sizes], "id": range(len(sizes))})
    got = list(bpe.parts(batch))
    assert [i for p in got for i in p["id"].to_pylist()] == list(range(len(sizes)))
    assert all(p.num_rows == 1 or sum(map(len, p["text"].to_pylist())) <= bpe.PART_BYTES for p in got)
    assert not list(bpe.parts(batch.slice(0, 0)))
