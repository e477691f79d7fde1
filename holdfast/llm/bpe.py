"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that lies inside no token of the vocabulary is a certain cut: merging only ever builds
vocabulary tokens, so no merge can span the pair, and the two sides can be encoded on their own and concatenated.
Texts are cut at special tokens, the pieces into the words of the tokenizer's pattern, and the words at their certain cuts. Words and
fragments that a process has met before are looked up, so only new ones are merged.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: The byte-level alphabet and the word pattern are fixed values of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Words and fragments that a process remembers; beyond that its memory starts afresh. Longer ones are not kept.
REMEMBERED, LONGEST = 200_000, 48
#: Bytes of text that are cut and encoded at a time, one text at least: their words are held as objects of their own.
PART_BYTES = 1 << 19
#: Fragments above this length are merged with a heap, shorter ones by repeated search.
SHORT = 48
NONE = 1 << 60
#: Texts without characters beyond this use the same pattern with its classes written out, which is faster.
NEAR = 0x250
BEYOND = re.compile(f"[^\\x00-{chr(NEAR - 1)}]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable bytes for themselves, the others from 256 on."""
    rest = [b for b in range(256) if b not in set(PLAIN)]
    return {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


def near_pattern() -> str:
    """PATTERN for characters below NEAR."""
    classes = {k: "".join(re.escape(chr(c)) for c in range(NEAR) if regex.match(k, chr(c))) for k in (r"\s", r"\p{L}", r"\p{N}")}
    s = classes[r"\s"]
    written = PATTERN.replace(r"\s+(?!\S)", f"[{s}]+(?![^{s}])").replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(classes.values()) + "]")
    for k in classes:
        written = written.replace(k, f"[{classes[k]}]")
    return written


class Codec:
    """Encoder and decoder of one vocabulary file (`tokenizers` JSON of a byte-level BPE)."""

    def __init__(self, spec: dict):
        letters, model = byte_letters(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in self.special}
        ids = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [ids.get(bytes([b]), -1) for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges = [(ids[raw[a]], ids[raw[b]], ids[raw[a] + raw[b]]) for a, b in pairs]
        self.rank = {a << 32 | b: r for r, (a, b, _) in enumerate(merges)}
        self.made = [c for _, _, c in merges]
        self.certain_cut = np.ones(1 << 16, bool)  # by pair of bytes
        inside = np.frombuffer(b"".join(t[i : i + 2] for t in ids for i in range(len(t) - 1)), np.uint8).astype(np.int64).reshape(-1, 2)
        self.certain_cut[inside[:, 0] << 8 | inside[:, 1]] = False
        self.words, self.near_words = regex.compile(PATTERN), re.compile(near_pattern())
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.fragments: dict[bytes, list[int]] = {}
        self.known: dict[str, tuple] = {}

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the pair of lowest rank is merged, leftmost first, until no pair has a rank."""
        parts = [self.of_byte[b] for b in fragment]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 32 | b, NONE) for a, b in pairwise(parts)]
        while ranks and (r := min(ranks)) != NONE:
            i = ranks.index(r)
            parts[i : i + 2] = (made[r],)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(made[r] << 32 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | made[r], NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a linked list and a heap: n log n for texts without any cut."""
        n, rank = len(parts), self.rank.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(pairwise(parts)) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[r], -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for x, y in ((i, k), (left[i], i)):
                if x >= 0 and y >= 0 and (s := rank(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def split(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """All pieces cut at certain cuts: the fragments of all, and where each piece ends among them."""
        buffer = b"".join(pieces)
        codes = np.frombuffer(buffer, np.uint8)
        cut = np.empty(len(codes), bool)
        cut[:-1] = self.certain_cut[codes[:-1].astype(np.int32) << 8 | codes[1:]]
        ends = np.cumsum([len(p) for p in pieces])
        cut[ends - 1] = True
        at = np.flatnonzero(cut) + 1
        return [buffer[a:b] for a, b in pairwise([0, *at.tolist()])], np.searchsorted(at, ends, "right")

    def learn(self, words: list[str]) -> dict[str, tuple]:
        """(ids as little-endian 32-bit numbers, ids as text, decoded bytes) of each word; short ones are remembered."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        if len(self.fragments) > REMEMBERED:
            self.fragments.clear()
        fragments, ends = self.split([w.encode() for w in words])
        found, known, start = {}, self.fragments, 0
        for word, end in zip(words, ends.tolist(), strict=True):
            ids: list[int] = []
            for f in fragments[start:end]:
                if (got := known.get(f)) is None:
                    got = self.merge(f)
                    if end - start > 1 and len(f) <= LONGEST:
                        known[f] = got
                ids += got
            start = end
            found[word] = np.array(ids, "<i4").tobytes(), ",".join(map(str, ids)), self.decode_bytes(ids)
            if len(word) <= LONGEST:
                self.known[word] = found[word]
        return found

    def cut(self, text: str) -> list[str]:
        """Special tokens and the words of the pattern between them, in order."""
        if self.at_special and self.at_special.search(text):
            pieces = [p for p in self.at_special.split(text) if p]
            return [w for p in pieces for w in ([p] if p in self.special else self.words.findall(p))]
        return self.words.findall(text) if BEYOND.search(text) else self.near_words.findall(text)

    def encode_batch(self, texts: list[str]) -> list[list[tuple]]:
        """For each text the entries of its words in order (see `learn`)."""
        cuts = [self.cut(t) for t in texts]
        known = self.known
        all_words = set(chain.from_iterable(cuts)) - self.special.keys()
        found = {w: known[w] for w in all_words if w in known}
        if len(found) < len(all_words):
            found |= self.learn([w for w in all_words if w not in found])
        found |= {s: (np.array([i], "<i4").tobytes(), str(i), s.encode()) for s, i in self.special.items()}
        return [[found[w] for w in cut] for cut in cuts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([e[0] for e in self.encode_batch([text])[0]]), "<i4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def kept_by_process() -> dict:
    """A dict that lives as long as a Python worker; functions sent by value get fresh globals with each task."""
    return vars(sys.modules.setdefault("_holdfast_llm", types.ModuleType("_holdfast_llm")))


def codec(vocabulary: str) -> Codec:
    """The codec of a vocabulary given as JSON text, built once per process."""
    kept, key = kept_by_process(), hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in kept:
        kept[key] = Codec(json.loads(vocabulary))
    return kept[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read on the driver (a local file) and sent once to each executor."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int), n_tokens, decoded text.

    Null texts count as empty and have no ids. Rows are independent of each other: repeated ids or texts and other
    columns do no harm, and an empty table gives an empty result. Nothing is shuffled.
    """
    return mapped(docs, vocabulary, id_col, text_col, {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded": pa.string()}, _whole)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode`, with SHA-256 of the comma-joined ids and of the decoded text in place of both."""
    return mapped(docs, vocabulary, id_col, text_col, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, _digests)


def _whole(entries: list[tuple]) -> tuple:
    ids = np.frombuffer(b"".join([e[0] for e in entries]), "<i4")
    return ids, len(ids), b"".join([e[2] for e in entries]).decode("utf-8", "replace")


def _digests(entries: list[tuple]) -> tuple:
    joined = ",".join([e[1] for e in entries]).encode()
    decoded = b"".join([e[2] for e in entries]).decode("utf-8", "replace").encode()
    return joined.count(b",") + bool(joined), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most PART_BYTES of text, or of one longer text."""
    at, total = 0, 0
    for end, size in enumerate(pc.binary_length(batch["text"]).to_pylist()):
        if end > at and total + size > PART_BYTES:
            yield batch.slice(at, end - at)
            at, total = end, 0
        total += size
    if at < batch.num_rows:
        yield batch.slice(at)


def mapped(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, columns: dict[str, pa.DataType], row: Callable[[list[tuple]], tuple]) -> DataFrame:
    """`row` of each text's entries, beside its id."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a fixed file of a few MB
    source = small_batches(docs).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ddl = {pa.list_(pa.int32()): "array<int>", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a worker may have served another stage before
        own = codec(sent.value)
        for batch in batches:
            for part in parts(batch):
                done = list(zip(*map(row, own.encode_batch(part["text"].to_pylist())), strict=True))
                yield pa.RecordBatch.from_arrays([part["id"], *[pa.array(c, k) for k, c in zip(columns.values(), done, strict=True)]], ["id", *columns])

    return source.mapInArrow(run, ", ".join([f"id {source.schema['id'].dataType.simpleString()}", *[f"{n} {ddl[k]}" for n, k in columns.items()]])).withColumnRenamed("id", id_col)
