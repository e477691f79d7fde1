import random

import public_tokenizers
import pytest
import sentencepiece

from holdfast.llm import marked_words as M

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return M.codec(M.read_model(PATH))


@pytest.fixture(scope="module")
def theirs():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    fixed = ["", " ", "  ", "   a  b\n\n c\t ", "\n", "\n a", "a \n", "<s>", "</s> <unk> <0x0A> <0x41>", "日本語テキスト 😀😀 é", "▁", "▁a", " ▁ a", "a▁b ▁▁c", "⁇ x", "�", "﻿x", "à", "\x00", "a\x00b", "don't I'LL\xa0x", "x\r\n y", "　a", "​"]
    fixed += ["a" * 30_000, "ab1 " * 20_000, " " * 5_000, "é" * 5_000, "ab" * 3_000 + " " * 300 + "x", "日本" * 2_000, "\n" * 4_000, " \n" * 2_000, "▁" * 50]
    rng = random.Random(5)
    sets = [[32, 9, 10, 0x85, 0xA0, 97, 98, 0x2028, 39, 115], [32, 0x2581, 97, 10, 98], [*range(32, 127)], [*range(1, 0x24F)], [*range(1, 0xD7FF)] + [*range(0x1F300, 0x1F600)], [32, 101, 110, 116, 104, 111], [0x4E00, 0x65E5, 0x672C, 32]]
    return fixed + ["".join(chr(rng.choice(s)) for _ in range(rng.randrange(90))) for s in sets for _ in range(400)]


def test_equals_the_library_and_comes_back(own, theirs):
    for t in texts():
        ids = theirs.encode(t)
        assert own.encode(t) == ids, t[:60]
        assert own.decode(ids) == theirs.decode(ids) == t.replace("▁", " "), t[:60]


def test_words_of_the_library_are_segmented_alike_alone(own, theirs):
    for t in texts():
        assert "".join(own.cut(t)) == (" " + t if t else "")


def test_decodes_any_ids_as_the_library(own, theirs):
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.randrange(3, 32_000) for _ in range(rng.randrange(20))]
        assert own.decode(ids) == theirs.decode(ids)


def test_table_starts_afresh(own, theirs, monkeypatch):
    monkeypatch.setattr(M, "REMEMBERED", 5)
    for t in ("one two three four", "five six seven eight nine ten", "one two three"):
        assert own.encode(t) == theirs.encode(t)


def test_parts_of():
    assert list(M.parts_of([])) == []
    assert list(M.parts_of([3, 3, 3, 9, 0, 1], 6)) == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_other_models_are_refused(own):
    def piece(text, kind=1):
        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    with pytest.raises(ValueError, match="only BPE"):
        M.PieceCodec(piece("a"))
    settings = b"\x12\x05\x18\x02\x98\x02\x01" + b"\x1a\x04\x18\x01\x20\x00"
    assert M.PieceCodec(piece("a") + settings).encode("a")
    with pytest.raises(ValueError, match="crosses"):
        M.PieceCodec(piece("a▁") + settings)
    with pytest.raises(ValueError, match="only BPE"):
        M.PieceCodec(piece("a", 4) + settings)


def test_tables(docs, theirs):
    model = M.read_model(PATH)
    long = "lorem ipsum " * 50_000
    got = {r["doc_id"]: r for r in M.encode(docs([(1, "some text"), (2, None), (3, ""), (4, long)]), model).collect()}
    assert got[1]["ids"] == theirs.encode("some text") and got[1]["decoded"] == "some text" and got[1]["n_tokens"] == 2
    assert got[2]["ids"] == got[3]["ids"] == [] and got[2]["decoded"] == ""
    assert got[4]["ids"] == theirs.encode(long) and got[4]["decoded"] == long
    digests = M.encode_digests(docs([(None, None), (1, "x"), (1, "x")]), model)
    assert [r["n_tokens"] for r in digests.orderBy("n_tokens").collect()] == [0, 1, 1]
    assert M.encode(docs([]), model).count() == 0
