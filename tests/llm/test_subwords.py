import random
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from holdfast.llm import quality, subwords, toxicity

BAD = ["scoundrel", "nitwit", "blockhead"]
SMALL = replace(toxicity.SETTINGS, bits=14, steps=3000, neutral=40)


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    letters = "abcdefgh"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        text, bad = [rng.choice(words) for _ in range(rng.randint(20, 120))], rng.random() < 0.3
        for _ in range(len(text) // 15 + 1 if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(BAD)
        out.append((i, " ".join(text), int(bad)))
    return out


def brute_score(text, s, weights, bias):
    """The same sums word by word in plain Python."""
    m, mask = int(subwords.MULTIPLIER), (1 << 64) - 1

    def mix(h):
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & mask
        return h ^ (h >> 29)

    def code(chars):
        h = 0
        for c in chars:
            h = (h * m + ord(c) + 1) & mask
        return h

    grams, hashes = [], []
    for w in (text.lower() if s.lower else text).split():
        # the running sum of the model has its powers rising from the first letter, the space before being letter zero
        hashes.append(sum((ord(c) + 1) * pow(m, i, 1 << 64) for i, c in enumerate(w)) & mask)
        for n in range(s.shortest, s.longest + 1):
            grams += [mix((code(f" {w} "[i : i + n]) + n) & mask) for i in range(len(w) + 3 - n)]
    grams += [mix(h) for h in hashes]
    grams += [0 if a == b else mix((a * m + b + 2) & mask) for a, b in zip(hashes, hashes[1:])]
    total = sum(float(weights[g >> (64 - s.bits)]) for g in grams)
    return 1 / (1 + np.exp(-(bias + (total / (len(grams) + s.neutral) if grams else 0))))


def test_score_is_the_average_of_all_grams():
    weights = np.random.default_rng(1).normal(0, 5, 1 << SMALL.bits).astype(np.float32)
    for text in ("", " ", "a", "One two  two\nthree", "Ünïcode wörds ünd émojis 😀😀", "x" * 50, " ".join(["repeat"] * 40)):
        assert subwords.score_text(text, SMALL, weights, 0.3) == pytest.approx(brute_score(text, SMALL, weights, 0.3), abs=1e-6)


def test_pieces_lose_nothing(monkeypatch):
    """The score and the words of a text are the same however it is cut, pairs across a cut and long words included."""
    weights = np.random.default_rng(1).normal(0, 5, 1 << SMALL.bits).astype(np.float32)
    texts = [" ".join(f"word{i % 977}" for i in range(3_000)), "y" * 2_000 + " and " + "ab" * 3_000, "z" * 700, "one " * 500]
    want = [subwords.score_text(t, SMALL, weights, 0.0) for t in texts]
    words = [subwords.all_word_hashes(t, True).tolist() for t in texts]
    assert want[0] == pytest.approx(brute_score(texts[0], SMALL, weights, 0.0), abs=1e-6)
    for piece in (40, 333, 1024):
        monkeypatch.setattr(subwords, "PIECE", piece)
        assert [subwords.score_text(t, SMALL, weights, 0.0) for t in texts] == pytest.approx(want, abs=1e-9)
        assert [subwords.all_word_hashes(t, True).tolist() for t in texts] == words


def test_learns_words_and_their_misspellings():
    rows = corpus()
    model = subwords.train([t for _, t, _ in rows[:450]], [y for *_, y in rows[:450]], SMALL)
    weights, bias = model.weights()
    right = [(subwords.score_text(t, SMALL, weights, bias) >= 0.5) == y for _, t, y in rows[450:]]
    assert np.mean(right) > 0.95
    clean = next(t for _, t, y in rows if not y)
    assert subwords.score_text(clean + " scoundrell nitwitt bl0ckhead" * 3, SMALL, weights, bias) > subwords.score_text(clean, SMALL, weights, bias)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus()
    labels = [(i, y, 1 - y, "x") for i, _, y in rows] + [(None, 1, 1, "x"), (5000, 1, 1, "x"), (1, None, None, "x"), (2, 7, 7, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int"), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int, text string")


def test_held_out_rows_are_never_learned_from(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.classify(docs, x, SMALL).orderBy("doc_id").collect() for x in (labels, flipped))
    assert [r["score"] for r in one] == [r["score"] for r in two]
    for r in one:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(labelled, module, column):
    docs, labels = labelled
    truth = {i: y for i, _, y in corpus()}
    got = [r for r in module.classify(docs, labels, SMALL).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == (truth[r["doc_id"]] if column == "toxic" else 1 - truth[r["doc_id"]]) for r in got]) > 0.9


def test_odd_tables(labelled, spark):
    docs, labels = labelled
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "word " * 100_000)], "doc_id bigint, text string")
    got = toxicity.classify(odd, labels, SMALL).collect()
    assert len(got) == 4 and sum(r["doc_id"] is None and not r["held_out"] for r in got) == 1
    assert toxicity.classify(docs.limit(0), labels, SMALL).count() == 0
    nothing = toxicity.classify(docs, labels.limit(0), SMALL)
    assert {r["score"] for r in nothing.collect()} == {0.5}


def test_repeated_ids_send_one_text_each(labelled, spark):
    docs, labels = labelled
    more = docs.unionByName(docs.withColumn("text", F.concat(F.lit("~"), "text")))
    one, two = (subwords.fit(x, labels, "toxic", SMALL) for x in (docs, more))
    assert (one.vectors == two.vectors).all()


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "decimal(12,0)"])
def test_picked_ids_need_no_python_workers(labelled, monkeypatch, kind):
    """The picked ids go to Spark as they are; of any type."""
    docs, labels = (t.withColumn("doc_id", F.col("doc_id").cast(kind)) for t in labelled)
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("rows sent through Python workers"))
    model = subwords.fit(docs, labels, "toxic", SMALL)
    assert np.any(model.output)


def test_remove_keeps_whole_rows(labelled):
    docs, labels = labelled
    left = toxicity.remove(docs, labels, SMALL)
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in left.collect()}
    assert kept == {r["doc_id"] for r in toxicity.classify(docs, labels, SMALL).collect() if not r["predicted"]}
