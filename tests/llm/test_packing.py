import random
from collections import defaultdict

import numpy as np
import pytest

from holdfast.llm import packing


def words():
    """A tokenizer of words by length, some of them above 16 bits."""
    return lambda text: [70_000 if w == "big" else len(w) for w in text.split()]


def naive(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits) if fits else size
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return sorted(rooms)


def test_best_fit_decreasing_equals_the_naive_search():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.choice([1, 7, 16, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randrange(60))]
        rows = packing.best_fit_decreasing(lengths, size)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(size - sum(lengths[i] for i in r) for r in rows) == naive(lengths, size)


@pytest.mark.parametrize("group", [1 << 21, 50])
def test_every_token_comes_back(docs, group):
    rng = random.Random(2)
    texts = {i: " ".join("x" * rng.randint(1, 9) for _ in range(rng.choice([0, 3, 10, 16, 17, 40, 100]))) for i in range(60)}
    texts[100], texts[101], texts[102] = "big word big", None, ""
    size = 16
    got = packing.pack(docs(list(texts.items())), words, size, pad=99, group=group).collect()
    found = defaultdict(dict)
    for r in got:
        ids, positions, lengths = packing.matrix([r["ids"]], size)[0], packing.matrix([r["positions"]], size)[0], r["lengths"]
        assert lengths[0] == 0 and lengths[-1] == r["n_tokens"] <= size and len(r["doc_ids"]) == len(r["parts"]) == len(lengths) - 1
        assert (ids[r["n_tokens"] :] == 99).all() and (positions[r["n_tokens"] :] == 0).all()
        for i, p, a, b in zip(r["doc_ids"], r["parts"], lengths, lengths[1:]):
            assert p not in found[i] and positions[a:b].tolist() == list(range(b - a))
            found[i][p] = ids[a:b].tolist()
    for i, t in texts.items():
        assert [x for p in sorted(found[i]) for x in found[i][p]] == words()(t or "")
    if group > 50:
        used = sum(r["n_tokens"] for r in got)
        assert len(got) == sum(len(words()(t or "")) // size for t in texts.values()) + len(naive([n for t in texts.values() if (n := len(words()(t or "")) % size)], size)) and used <= len(got) * size


def test_repeated_and_null_ids(docs):
    got = packing.pack(docs([(1, "a b"), (1, "a b"), (None, "c"), (2, "d " * 33)]), words, 8).collect()
    assert sum(r["n_tokens"] for r in got) == 2 + 2 + 1 + 33
    assert sorted((i is None, i or 0) for r in got for i in r["doc_ids"]) == [(False, 1), (False, 1)] + [(False, 2)] * 5 + [(True, 0)]


def test_written_matrices(docs, spark, tmp_path):
    packing.write(packing.pack(docs([(1, "a bb ccc"), (2, "dd e")]), words, 4), str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    assert sorted(packing.matrix([r["ids"] for r in rows], 4).sum(1).tolist()) == [3, 6]


def test_empty(docs):
    assert packing.pack(docs([]), words, 8).count() == 0
    assert packing.pack(docs([(1, None)]), words, 8).count() == 0
    assert isinstance(packing.matrix([], 4), np.ndarray)
