"""Subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its hashed character n-grams (inside words, with the space before and after as borders), words and
word pairs. Every bucket has a learned vector; a text is the average of its vectors, and a linear softmax gives the
class. Words never seen share the n-gram vectors of similar ones. Two pairs of equal words share one vector, so that
repetition itself can be learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
#: Characters handled at a time; longer texts go through in pieces. Nothing is lost or counted twice where they meet.
PIECE = 1 << 17
#: Largest step in any direction, for stable training.
CLIP = 4.0


@dataclass(frozen=True)
class Settings:
    """Shape and training of a model. `ones` and `zeros` bound the labelled rows of each class that are learned from.

    Every row is learned from equally often, `steps` times in all. `neutral` zero vectors join each average, so that a few chance n-grams of a short text do not decide it.
    A vector loses the share `decay` of its length whenever a text with it is learned.
    """

    bits: int = 18
    shortest: int = 3
    longest: int = 6
    lower: bool = True
    dim: int = 8
    steps: int = 24_000
    rate: float = 4.0
    ones: int = 1500
    zeros: int = 4000
    neutral: int = 400
    decay: float = 0.0
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    vectors: np.ndarray  # bucket x dim
    output: np.ndarray  # dim x 2
    bias: np.ndarray  # 2

    def weights(self) -> tuple[np.ndarray, float]:
        """Score of each bucket towards class 1, and the bias: the softmax of averages needs no more than their average."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(PIECE + 2, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = _powers(MULTIPLIER), _powers(INVERSE)


def pieces(text: str, lower: bool) -> Iterator[list[str]]:
    """The words of the text in runs of bounded length; a word above the bound is a run of its own."""
    run, size = [], 0
    for word in (text.lower() if lower else text).split():
        if run and size + len(word) + 2 > PIECE:
            yield run
            run, size = [], 0
        run.append(word)
        size += len(word) + 1
    if run:
        yield run


def codes_of(run: list[str]) -> np.ndarray:
    """Character codes of a run with single spaces around its words."""
    return np.frombuffer(f" {' '.join(run)} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, s: Settings, known: int = 0) -> Iterator[np.ndarray]:
    """Bucket numbers of the character n-grams by length; those that end within the first `known` characters are left out."""
    shift = np.uint64(64 - s.bits)
    c = codes.astype(np.uint64) + np.uint64(1)
    space = codes == 32
    h = c.copy()
    inside = np.ones(len(c), bool)  # no space between first and last character
    for n in range(2, s.longest + 1):
        if len(c) < n:
            break
        h = h[:-1] * MULTIPLIER + c[n - 1 :]
        inside = inside[:-1] if n == 2 else inside[:-1] & ~space[n - 2 : -1]
        if n >= s.shortest:
            # a space next to itself never occurs, so a gram that is all border cannot either
            new = max(0, known - n + 1)
            yield (mixed(h[new:][inside[new:]] + np.uint64(n)) >> shift).astype(np.int32)


def buckets(text: str, s: Settings) -> Iterator[np.ndarray]:
    """Bucket numbers of a text: character n-grams by length, words, word pairs."""
    shift, last = np.uint64(64 - s.bits), np.zeros(0, np.uint64)
    for run in pieces(text, s.lower):
        if len(run[0]) <= PIECE:
            codes = codes_of(run)
            yield from grams(codes, s)
            words = word_hashes(codes)
        else:
            bordered = f" {run[0]} "
            for at in range(0, len(bordered), PIECE):
                known = min(at, s.longest - 1)
                yield from grams(np.frombuffer(bordered[at - known : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32), s, known)
            words = long_word_hash(run[0])
        yield (mixed(words) >> shift).astype(np.int32)
        words = np.concatenate([last, words])
        pairs = mixed(words[:-1] * MULTIPLIER + words[1:] + np.uint64(2))
        pairs[words[:-1] == words[1:]] = 0
        yield (pairs >> shift).astype(np.int32)
        last = words[-1:]


def all_word_hashes(text: str, lower: bool) -> np.ndarray:
    """A hash of each word of a text, in order."""
    found = [word_hashes(codes_of(run)) if len(run[0]) <= PIECE else long_word_hash(run[0]) for run in pieces(text, lower)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each word of a run: differences of one running sum, brought to the same power."""
    at = np.flatnonzero(codes == 32)
    total = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * POWERS[: len(codes)])
    return (total[at[1:] - 1] - total[at[:-1]]) * INVERSES[at[:-1] + 1]


def long_word_hash(word: str) -> np.ndarray:
    """The same hash of one word of any length, some characters at a time."""
    total, mask = 0, (1 << 64) - 1
    for at in range(0, len(word), PIECE):
        codes = np.frombuffer(word[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        part = int(((codes.astype(np.uint64) + np.uint64(1)) * POWERS[: len(codes)]).sum(dtype=np.uint64))
        total = (total + part * pow(int(MULTIPLIER), at, 1 << 64)) & mask
    return np.array([total], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the hash over its high bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def bag(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares (empty for an empty text)."""
    found = list(buckets(text, s))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, counts = np.unique(np.concatenate(found), return_counts=True)
    return ids.astype(np.int32), (counts / (counts.sum() + s.neutral)).astype(np.float32)


def bags(texts: list[str], labels: list[int], s: Settings) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[int, int, int]], list[int]]:
    """Buckets and shares of all texts that have any, end to end in blocks; block, begin and end of each text; its label.

    Blocks are few large arrays, so that the driver's memory is given back after the training, and are never copied together.
    """
    blocks, spots, ys = [], [], []
    for start in range(0, len(texts), 250):
        own = [(*bag(t, s), int(y)) for t, y in zip(texts[start : start + 250], labels[start : start + 250], strict=True)]
        own = [x for x in own if len(x[0])]
        if own:
            at = np.cumsum([0, *[len(x[0]) for x in own]]).tolist()
            spots += [(len(blocks), a, b) for a, b in pairwise(at)]
            ys += [x[2] for x in own]
            blocks.append((np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])))
    return blocks, spots, ys


def train(texts: list[str], labels: list[int], s: Settings, prior: float | None = None) -> Model:
    """Stochastic gradient descent, one text at a time, with a falling rate. `prior`: share of class 1 among all labelled rows."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    output, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    blocks, spots, ys = bags(texts, labels, s)
    rows, ones = len(ys), sum(ys)
    epochs, done = -(-s.steps // max(1, rows)), 0
    steps = max(1, rows * epochs)
    share = {1: 0.5 * rows / max(ones, 1), 0: 0.5 * rows / max(rows - ones, 1)}
    for _ in range(epochs):
        for k in rng.permutation(rows):
            (block, start, end), y = spots[k], ys[k]
            ids, w = blocks[block][0][start:end], blocks[block][1][start:end]
            rate = s.rate * (1 - done / steps) * share[y]
            mean = w @ vectors[ids]
            logits = mean @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = np.clip(output @ p, -CLIP, CLIP)
            output -= rate * np.outer(np.clip(mean, -CLIP, CLIP), p)
            bias -= 0.1 * rate * p
            vectors[ids] = vectors[ids] * (1 - s.decay) - (rate * 20) * w[:, None] * back
            done += 1
    if prior is not None and 0 < prior < 1:
        bias = bias + np.array([np.log(1 - prior), np.log(prior)], np.float32) - np.log(0.5)
    return Model(s, vectors, output, bias.astype(np.float32))


def score_text(text: str, s: Settings, weights: np.ndarray, bias: float) -> float:
    """Probability of class 1; an empty text has no vectors and gets the bias alone."""
    total, n = 0.0, 0
    for b in buckets(text, s):
        total += float(weights[b].sum(dtype=np.float64))
        n += len(b)
    z = bias + (total / (n + s.neutral) if n else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(id_col: str) -> F.Column:
    """The fold that is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most `ones` and `zeros` labelled rows of the other folds, picked by the hash of their id.

    Only these picked ids and one whole text of each reach the driver, a bounded number of rows. Of documents that
    repeat an id the least text counts; an id with both labels is learned as both. Labels that are null or neither 0
    nor 1 are passed over; a label without a document is not counted. Without any usable row all scores are 0.5.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out("id"))
    rank = F.md5(F.concat_ws(":", F.lit(str(s.seed)), F.col("id").cast("string")))
    picked = [r for y, n in ((0, s.zeros), (1, s.ones)) for r in own.filter(F.col("y") == y).groupBy("id", "y").agg(F.count("*").alias("n")).orderBy(rank, "id").limit(n).collect()]
    if not picked:
        return Model(s, np.zeros((1 << s.bits, s.dim), np.float32), np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # an Arrow table: rows would go through Python workers of another kind, which stay beside those of the columns
    ids = pa.table({"id": [r["id"] for r in picked], "y": [r["y"] for r in picked]})
    wanted = docs.sparkSession.createDataFrame(ids, own.select("id", "y").schema)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(wanted), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("id", "text", "y").collect()
    texts, ys = [r["text"] for r in rows], [r["y"] for r in rows]
    del rows
    return train(texts, ys, s, counts.get(1, 0) / sum(counts.values()))


def scorer(docs: DataFrame, model: Model):
    """A column function: probability of class 1 of a text column (null counts as empty)."""
    weights, bias = model.weights()
    sent = small_batches(docs).sparkSession.sparkContext.broadcast(weights)  # 4 bytes for each of 2**bits buckets
    s = model.settings

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t or "", s, sent.value, bias) for t in texts], dtype="float64")

    return scores


def score(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted. Reads ids and whole texts only; nothing is shuffled.

    Null texts count as empty and score the bias alone; ids may repeat or be null (never held out); an empty table
    gives an empty result.
    """
    scored = docs.select(F.col(id_col).alias("id"), scorer(docs, model)(text_of(text_col)).alias("score"))
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
