"""SentencePiece BPE encoding and decoding by a table of distinct marked words.

The model writes a space as the marker U+2581 and puts one in front of the text. If no piece holds a marker behind
another character, no merge can reach across the place where a marker follows a word, so a text falls into marked words
(markers and what follows them) that are segmented on their own. Each task keeps a table of the distinct marked words it
has met: a word is segmented once and its ids are joined back by position wherever it stands. Two neighbouring
characters that stand side by side in no piece are a certain cut as well, so a new word with a comma behind it is put
together from what is known. Nothing is shuffled: a word that makes a third of all words costs a look-up.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import kept_by_process
from .common import small_batches, text_of

MARKER = "▁"
#: Kinds of pieces and of models, fixed values of the format.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
#: Words that a table holds before it starts afresh; longer words are not kept.
REMEMBERED, LONGEST = 400_000, 64
#: Pairs of characters below this are looked at for certain cuts.
NEAR = 0x250
#: Words above this length are merged with a heap, shorter ones by repeated search.
SHORT = 40
#: Characters that are worked on at a time.
PART = 1 << 21


def wire_fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message: numbers as int, the rest as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, message[at : at + size]
        at += size


class PieceCodec:
    """Encoder and decoder of one model file: BPE with byte fallback, text taken as it is, markers only in front of words.

    Models with other settings are refused with a ValueError.
    """

    def __init__(self, model: bytes):
        fields = list(wire_fields(model))
        parts = [dict(wire_fields(v)) for f, v in fields if f == 1]
        trainer, normalizer = (dict(wire_fields(next((v for f, v in fields if f == n), b""))) for n in (2, 3))
        pieces = [p[1].decode() for p in parts]
        kinds = [p.get(3, NORMAL) for p in parts]
        scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in parts]
        usual = normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1) and not normalizer.get(2) and not trainer.get(24, 0)
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0) or not usual or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, a leading marker and no normalisation are known")
        # markers are written as spaces from here on, as in the text
        self.ids = {p.replace(MARKER, " "): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece crosses a marker, words cannot be segmented on their own")
        self.rank = {p: -scores[i] for p, i in self.ids.items() if len(p) > 1}
        self.of_byte = [0] * 256
        self.surface = [p.replace(MARKER, " ").encode() for p in pieces]
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == BYTE:
                self.of_byte[int(p[3:5], 16)] = i
                self.surface[i] = bytes([int(p[3:5], 16)])
            elif k == CONTROL:
                self.surface[i] = b""
            elif k == UNKNOWN:
                self.surface[i] = trainer.get(44, " ⁇ ".encode())
        joined = set("".join(self.rank))
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined and c != 32) or r"(?!)"
        self.words = re.compile(f"[ {MARKER}]*+[^ {MARKER}{lone}]+|[ {MARKER}]+|[{lone}]+")
        self.plain_words = re.compile(f" *+[^ {lone}]+| +|[{lone}]+")
        self.certain_cut = np.ones((NEAR, NEAR), bool)
        for a, b in {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}:
            if max(a, b) < chr(NEAR):
                self.certain_cut[ord(a), ord(b)] = False
        self.table: dict[str, tuple] = {}
        self.fragments: dict[str, tuple] = {}

    def segment(self, word: str) -> list[int]:
        """Ids of one fragment: the best scored pair that makes a piece is joined, leftmost first, until none does."""
        parts = list(word)
        parts = self._join_long(parts) if len(parts) > SHORT else self._join_short(parts)
        out, ids = [], self.ids
        for p in parts:
            if (i := ids.get(p)) is not None:
                out.append(i)
            else:  # a character that is no piece goes by its bytes
                out += [self.of_byte[b] for b in p.encode()]
        return out

    def _join_short(self, parts: list[str]) -> list[str]:
        rank, none = self.rank.get, float("inf")
        ranks = [rank(a + b, none) for a, b in pairwise(parts)]
        while ranks and (r := min(ranks)) != none:
            i = ranks.index(r)
            parts[i : i + 2] = (parts[i] + parts[i + 1],)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _join_long(self, parts: list[str]) -> list[str]:
        """The same with a linked list and a heap: n log n for words without any cut."""
        n, rank = len(parts), self.rank.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, a + b) for i, (a, b) in enumerate(pairwise(parts)) if (r := rank(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j] = made, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for x, y in ((i, k), (left[i], i)):
                if x >= 0 and y >= 0 and (s := rank(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (s, x, parts[x] + parts[y]))
        return [p for p in parts if p]

    def cut(self, text: str) -> list[str]:
        """The marked words of a text in order; joined they are the text behind its leading marker."""
        return (self.plain_words if text.isascii() else self.words).findall(" " + text) if text else []

    def split(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """All words cut at certain cuts: the fragments of all, and where each word ends among them."""
        flat = "".join(words)
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        near = np.minimum(codes, NEAR - 1)
        cut = np.empty(len(codes), bool)
        cut[:-1] = self.certain_cut[near[:-1], near[1:]] & (codes[:-1] < NEAR - 1) & (codes[1:] < NEAR - 1)
        ends = np.cumsum([len(w) for w in words])
        cut[ends - 1] = True
        at = np.flatnonzero(cut) + 1
        return [flat[a:b] for a, b in pairwise([0, *at.tolist()])], np.searchsorted(at, ends, "right")

    def learn(self, words: list[str]) -> dict[str, tuple]:
        """(ids as text, decoded bytes) of each word; short words enter the table."""
        if len(self.table) + len(words) > REMEMBERED:
            self.table.clear()
        if len(self.fragments) > REMEMBERED:
            self.fragments.clear()
        fragments, ends = self.split([w.replace(MARKER, " ") for w in words])
        found, known, table, start = {}, self.fragments, self.table, 0
        for word, end in zip(words, ends.tolist(), strict=True):
            own = []
            for f in fragments[start:end]:
                if (got := known.get(f)) is None:
                    ids = self.segment(f)
                    got = ",".join(map(str, ids)), b"".join([self.surface[i] for i in ids])
                    if len(f) <= LONGEST:
                        known[f] = got
                own.append(got)
            start = end
            found[word] = own[0] if len(own) == 1 else (",".join([o[0] for o in own]), b"".join([o[1] for o in own]))
            if len(word) <= LONGEST:
                table[word] = found[word]
        return found

    def encode_batch(self, texts: list[str]) -> list[list[tuple]]:
        """For each text the entries of its marked words in order (see `learn`)."""
        cuts = [self.cut(t) for t in texts]
        distinct, table = set(chain.from_iterable(cuts)), self.table
        found = {w: table[w] for w in distinct if w in table}
        if len(found) < len(distinct):
            found |= self.learn([w for w in distinct if w not in found])
        return [[found[w] for w in cut] for cut in cuts]

    def encode(self, text: str) -> list[int]:
        return _whole(self.encode_batch([text])[0])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return as_text(b"".join([self.surface[i] for i in ids]))


def as_text(surface: bytes) -> str:
    """The text of joined surfaces: without the leading marker's space; bytes that are no UTF-8 become U+FFFD."""
    return surface.removeprefix(b" ").decode("utf-8", "replace")


def codec(model: bytes) -> PieceCodec:
    """The codec of a model file's content, built once per process."""
    kept, key = kept_by_process(), "pieces " + hashlib.sha256(model).hexdigest()
    if key not in kept:
        kept[key] = PieceCodec(model)
    return kept[key]


def read_model(path: str) -> bytes:
    """The model file's content, read on the driver (a local file) and sent once to each executor."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int), n_tokens, decoded text. No begin or end ids.

    Null texts count as empty and have no ids. Rows are independent of each other: repeated ids or texts and other
    columns, whatever their names, do no harm, and an empty table gives an empty result. Texts of any length are
    encoded whole. Nothing is shuffled.
    """
    return _mapped(docs, model, id_col, text_col, {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded": pa.string()}, _whole)


def encode_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode`, with SHA-256 of the comma-joined ids and of the decoded text in place of both; nulls, empty tables
    and repeated rows count as there."""
    return _mapped(docs, model, id_col, text_col, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, _digests)


def _whole(entries: list[tuple]) -> tuple:
    ids = np.array(",".join([e[0] for e in entries]).split(",") if entries else [], np.int32)
    return ids, len(ids), as_text(b"".join([e[1] for e in entries]))


def _digests(entries: list[tuple]) -> tuple:
    joined = ",".join([e[0] for e in entries]).encode()
    decoded = as_text(b"".join([e[1] for e in entries])).encode()
    return joined.count(b",") + bool(joined), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()


def parts_of(sizes: list[int], most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of together at most `most` characters, or of one text."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _mapped(docs: DataFrame, model: bytes, id_col: str, text_col: str, columns: dict[str, pa.DataType], row: Callable[[list[tuple]], tuple]) -> DataFrame:
    """`row` of each text's entries, beside its id."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed file of half a MB
    source = small_batches(docs).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ddl = {pa.list_(pa.int32()): "array<int>", pa.int64(): "bigint", pa.string(): "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in parts_of([len(t) for t in texts]):
                done = list(zip(*map(row, own.encode_batch(texts[a:b])), strict=True))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), *[pa.array(c, k) for k, c in zip(columns.values(), done, strict=True)]], ["id", *columns])

    schema = ", ".join([f"id {source.schema['id'].dataType.simpleString()}", *[f"{n} {ddl[k]}" for n, k in columns.items()]])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
