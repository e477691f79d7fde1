"""Packed token-id matrices: best-fit-decreasing with a segment tree over capacities.

Texts become token ids; documents longer than a row are split without loss into whole rows and a rest. Whole rows are
ready; the rests are dealt by hash to groups of bounded size, and each group is packed on its own, longest first, each
into the row with the least room that still holds it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import kept_by_process
from .common import small_batches, stored, text_of

#: Tokens of a group on average: what one task holds at a time (2 bytes each).
GROUP = 1 << 21


class Tokenizer:
    """Byte-level BPE by a file of ranks (`tiktoken` format); every string is ordinary text."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        return self.model.encode_ordinary(text)


class Capacities:
    """Open rows by the room they have left: a segment tree over 0..size tells the least room that is enough."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves < size + 1:
            self.leaves *= 2
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.counts[i] += by
            i //= 2

    def push(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def pop(self, least: int) -> tuple[int, int] | None:
        """The fullest row with at least this room, taken out: (room, row)."""
        i = least + self.leaves
        if not self.counts[i]:
            # up until a right sibling holds a row, then down its left edge
            while i > 1 and (i % 2 or not self.counts[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.counts[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Items of each row, longest first; no length is above `size`. Ties keep the given order."""
    open_rows, rows = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room, row = open_rows.pop(lengths[i]) or (size, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        open_rows.push(room - lengths[i], row)
    return rows


def pieces(docs: DataFrame, tokenizer: Callable[[], Callable[[str], list[int]]], size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, part, n, ids (little-endian 16 or 32 bit): each document in parts of `size` tokens and a rest."""
    source = small_batches(docs).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for id_, text in zip(part["id"].to_pylist(), part["text"], strict=True):
                    ids = np.array(encode(text.as_py()), "<u4")
                    rows += [(id_, k, len(own := ids[s : s + size]), own.astype("<u2").tobytes() if own.max() < 1 << 16 else own.tobytes()) for k, s in enumerate(range(0, len(ids), size))]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [part["id"].type, pa.int32(), pa.int32(), pa.binary()], strict=True)], ["id", "part", "n", "ids"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, part int, n int, ids binary")


def pack(docs: DataFrame, tokenizer: Callable[[], Callable[[str], list[int]]], size: int = 2048, pad: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per packed row: ids (binary, `size` little-endian 32-bit numbers, padded with `pad`), lengths (array,
    cumulative, from 0), positions (binary like ids, starting at 0 in each segment, 0 in the padding), doc_ids and parts
    of the segments in order, n_tokens.

    Every token of every document occurs once. Null texts count as empty; documents without tokens need no room and
    occur in no row. Repeated ids are kept apart by their rows; null ids stay null. Other columns are not read, and an
    empty table gives an empty result.
    """
    cut = stored(pieces(docs, tokenizer, size, id_col, text_col))
    rests = cut.filter(F.col("n") < size)
    tokens = rests.agg(F.sum("n")).first()[0] or 0
    groups = -(-tokens // group) or 1
    id_type = cut.schema["id"].dataType.simpleString()
    schema = f"ids binary, lengths array<int>, positions binary, doc_ids array<{id_type}>, parts array<int>, n_tokens int"

    def laid(items: list[tuple]) -> tuple:
        """A packed row of (id, part, n, ids)."""
        ids = np.full(size, pad, "<u4")
        positions = np.zeros(size, "<u4")
        ends = np.cumsum([0, *[n for _, _, n, _ in items]])
        for (_, _, n, own), start in zip(items, ends, strict=False):
            ids[start : start + n] = np.frombuffer(own, "<u2" if len(own) == 2 * n else "<u4")
            positions[start : start + n] = np.arange(n)
        return ids.tobytes(), ends.tolist(), positions.tobytes(), [x[0] for x in items], [x[1] for x in items], int(ends[-1])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield frame([laid([x]) for x in zip(*[c.to_pylist() for c in batch.slice(at, 500).columns], strict=True)], batch["id"].type)

    def frame(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(kind), pa.list_(pa.int32()), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, types, strict=True)], ["ids", "lengths", "positions", "doc_ids", "parts", "n_tokens"])

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("part", "ascending"), ("ids", "ascending")])
        items = list(zip(*[rows[c].to_pylist() for c in ("id", "part", "n", "ids")], strict=True))
        return pa.Table.from_batches([frame([laid([items[i] for i in row]) for row in best_fit_decreasing([x[2] for x in items], size)], rows["id"].type)])

    dealt = rests.withColumn("group", F.pmod(F.xxhash64("id", "part", "ids"), F.lit(groups)))
    rows = dealt.groupBy("group").applyInArrow(lambda key, t: packed(key, t.select(["id", "part", "n", "ids"])), schema)
    return cut.filter(F.col("n") == size).select("id", "part", "n", "ids").mapInArrow(whole, schema).unionByName(rows)


def write(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; `matrix` gives the numbers of a column of them back."""
    packed.write.parquet(path)


def matrix(rows: pd.Series | list, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<u4").reshape(-1, size)


def tokenizer_from(path: str, pattern: str, spark) -> Callable[[], Tokenizer]:
    """Reads the ranks on the driver and sends them once to each executor; a process builds its tokenizer once."""
    with open(path, encoding="ascii") as f:
        ranks = f.read()
    sent, key = spark.sparkContext.broadcast(ranks), hashlib.sha256((ranks + pattern).encode()).hexdigest()

    def get() -> Tokenizer:
        kept = kept_by_process()
        if key not in kept:
            kept[key] = Tokenizer(sent.value, pattern)
        return kept[key]

    return get
