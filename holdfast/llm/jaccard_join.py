"""N-gram Jaccard join: a MinHash LSH forest, matched prefixes shortened to the target recall, exact verification.

Texts are sets of hashed word n-grams; texts of equal sets are one from then on. Each tree of the forest orders the
signatures by its own choice of hash functions: a node of its trie is a shared prefix. Matching begins at long
prefixes, where groups are alike, and the prefixes are shortened until a pair at the threshold shares a node of some
tree with the target recall. On each level the members of a node are compared with one of them; what is verified makes
classes. Only nodes of the last level whose members are still in different classes are compared pair by pair, so no
link between classes is lost. Links inside a class are counted. Both are done in blocks, a product of incidence
matrices for each pair of blocks; pairs are never written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import parts
from .common import small, small_batches, stored, text_of
from .components import components
from .subwords import MULTIPLIER, all_word_hashes, mixed


@dataclass(frozen=True)
class Settings:
    """`hashes` functions make a signature, `trees` trees order it, the first `longest` functions of a tree's order make its
    longest prefix. `block` texts of a group are compared with as many at a time."""

    words: int = 5
    threshold: float = 0.8
    recall: float = 0.999
    hashes: int = 128
    trees: int = 32
    longest: int = 10
    block: int = 256
    seed: int = 11


def shingles(text: str, words: int) -> np.ndarray:
    """The set of a text's word n-grams as sorted hashes. Words are cut at white space, without case; fewer than `words`
    words make one n-gram, a text without words the empty set."""
    w = all_word_hashes(text, lower=True)
    if not len(w):
        return w
    size = min(words, len(w))
    h = w[: len(w) - size + 1].copy()
    for j in range(1, size):
        h = h * MULTIPLIER + w[j : len(w) - size + 1 + j]
    return np.unique(mixed(h + np.uint64(size)))


def signatures(sets: list[np.ndarray], multipliers: np.ndarray) -> np.ndarray:
    """Least value of each hash function over each set (sets must not be empty)."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), len(multipliers)), np.uint32)
    for i, m in enumerate(multipliers):
        out[:, i] = np.minimum.reduceat(((flat ^ (m >> np.uint64(7))) * m) >> np.uint64(32), starts)
    return out


def tree_orders(s: Settings) -> list[list[int]]:
    """For each tree its own order of hash functions, as far as its longest prefix goes."""
    rng = np.random.default_rng(s.seed)
    return [rng.permutation(s.hashes)[: s.longest].tolist() for _ in range(s.trees)]


#: What `recall_at` has counted in this process.
_COUNTED: dict[tuple, tuple[float, float]] = {}


def recall_at(s: Settings, depth: int, draws: int = 1_000_000) -> tuple[float, float]:
    """Share of pairs at the threshold that share a node of some tree at the depth, and its standard error.

    Trees use some functions in common, so they do not find a pair independently of each other. Each function agrees
    on a pair with the threshold's probability; the share is counted over drawn pairs, the draws are always the same.
    """
    if (s, depth, draws) in _COUNTED:
        return _COUNTED[s, depth, draws]
    rng, found, done = np.random.default_rng(s.seed + 2), 0, 0
    trees = [order[:depth] for order in tree_orders(s)]
    while done < draws:
        n = min(draws - done, 20_000)
        agree = np.ascontiguousarray((rng.random((n, s.hashes), np.float32) < s.threshold).T)
        hit = np.zeros(n, bool)
        for order in trees:
            hit |= agree[order].all(0)
        found, done = found + int(hit.sum()), done + n
    share = found / draws
    _COUNTED[s, depth, draws] = share, (share * (1 - share) / draws) ** 0.5
    return _COUNTED[s, depth, draws]


def met_at(s: Settings, depth: int) -> bool:
    """Whether the recall is met at the depth, by three standard errors. Trees with functions in common find less than
    independent ones, so a depth at which those do not meet it needs no count."""
    if 1 - (1 - s.threshold**depth) ** s.trees < s.recall:
        return False
    share, error = recall_at(s, depth)
    return share - 3 * error >= s.recall


def depths(s: Settings) -> list[int]:
    """The longest prefix, then the longest at which the recall is met by the trees as they are."""
    enough = (d for d in range(s.longest, 0, -1) if met_at(s, d))
    return sorted({s.longest, next(enough, 1)}, reverse=True)


def features(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """id, set_key (128-bit hash of the set), signature (null for the empty set) of every row."""
    multipliers = np.random.default_rng(s.seed + 1).integers(0, 1 << 63, s.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes = 0, [len(t.as_py()) for t in batch["text"]]
            while at < len(sizes):
                end, total = at, 0
                while end < len(sizes) and (end == at or total + sizes[end] <= 1 << 19):
                    total += sizes[end]
                    end += 1
                sets = [shingles(t.as_py(), s.words) for t in batch["text"].slice(at, end - at)]
                full = [x for x in sets if len(x)]
                rows = iter(signatures(full, multipliers) if full else ())
                signed = [next(rows).tobytes() if len(x) else None for x in sets]
                keys = [hashlib.md5(x.tobytes()).digest() for x in sets]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(at, end - at), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())], ["id", "set_key", "signature"])
                at = end

    return _source(docs, id_col, text_col).mapInArrow(run, "id bigint, set_key binary, signature binary")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))


def _shared(nodes: DataFrame) -> DataFrame:
    """(node, id, lead) of nodes with two members and more; the lead is the smallest."""
    shared = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("lead")).filter("n > 1").select("node", "lead")
    return nodes.join(shared, "node").select("node", "id", "lead")


def _nodes(signed: DataFrame, s: Settings, depth: int) -> DataFrame:
    """(node, id, ...) of every tree at a depth; a node is the hash of its tree and prefix."""
    trees = [F.xxhash64(F.lit(t), *[F.substring("signature", 4 * i + 1, 4) for i in order[:depth]]) for t, order in enumerate(tree_orders(s))]
    return signed.select(*[c for c in signed.columns if c != "signature"], F.explode(F.array(*trees)).alias("node"))


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_reaches(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), s.threshold) for p, q in zip(x, y, strict=True)], dtype=bool)

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    return stored(left.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").filter(alike("x", "y")).select("a", "b"))


def _reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= threshold * (len(both) - common) - 1e-9


def classes(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, n_links, n_copies, set_key.

    Two texts are linked when the Jaccard similarity of their n-gram sets is at or above the threshold; a class holds
    all that links connect, and is named by the smallest id in it. `n_links` counts the other different sets linked to
    the row's, `n_copies` the other rows of the same set. Null and empty texts have the empty set and are copies of
    each other. Ids are integers and only carried along: rows with null or repeated ids take part by their texts. The
    name of a class is null if all its ids are; classes that the same repeated id names differ in their set keys.
    Other columns are not read; an empty table gives an empty result.
    """
    rows, named = _named(docs, s, id_col, text_col)
    out = rows.join(small(named, 80), "set_key", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("named"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), "set_key")


def _named(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, set_key) of all rows; and for each set with copies or links its class_id, n_links, n_copies, and in `stays`
    whether it is the set that stays of its class: the one of the smallest id (nulls last), then of the smallest key."""
    rows = stored(features(docs, s, id_col, text_col))
    # each different set is one text; `id` is its number from here on
    alike = stored(rows.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("signature").alias("signature")).withColumn("id", F.monotonically_increasing_id()))
    reps = alike.filter("signature is not null").select("id", "signature")
    *longer, shortest = depths(s)
    nodes = stored(_shared(_nodes(reps, s, shortest)))
    ids = stored(nodes.select("id").distinct())
    sets = stored(_sets(docs, alike.join(small(ids, 16), "id", "left_semi").select("id", "set_key", "rep"), s, id_col, text_col))
    # every member of a node is compared with one of them, at long prefixes and at the shortest
    partnered = reps.join(small(ids, 16), "id", "left_semi")
    stars = nodes.select("id", "lead")
    for depth in longer:
        stars = stars.unionByName(_shared(_nodes(partnered, s, depth)).select("id", "lead"))
    pairs = stars.filter("id != lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    links = _verified(stored(pairs), sets, s)
    # members of a node that are still in different classes are compared among themselves
    bridges = _bridges(nodes.select("node", "id"), components(links), sets, s)
    groups = components(stored(links.unionByName(bridges)))
    counts = stored(_link_counts(groups, sets, s))
    # of each set that has copies or links: its class, links and copies
    linked = alike.join(small(groups, 24), "id").select("id", "component", "rep", "set_key")
    first = F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "set_key")).alias("first")
    tops = stored(linked.groupBy("component").agg(first).select("component", F.col("first.rep").alias("class_id"), F.col("first.set_key").alias("top")))
    of_class = groups.join(small(tops, 60), "component").join(counts, "id", "left").select("id", "class_id", "top", "n_links")
    joined = alike.select("id", "set_key", "rep", "n").join(of_class, "id", "left")
    alone = F.col("top").isNull()
    named = stored(joined.filter(F.col("top").isNotNull() | (F.col("n") > 1)).select(
        "set_key", F.when(alone, F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("n") - 1).alias("n_copies"),
        (alone | (F.col("top") == F.col("set_key"))).alias("stays"), F.lit(True).alias("named")))
    return rows.select("id", "set_key"), named


def _grouped(rows: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """`rows` with the component of an id; ids without links are their own."""
    named = groups.select(F.col("id").alias(column), F.col("component").alias("c"))
    return rows.join(small(named, 24), column, "left").withColumn("component", F.coalesce("c", column)).drop("c")


def _bridges(members: DataFrame, groups: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(a, b) for classes that a link between members of one node connects; classes are named by their smallest ids.

    Only nodes that hold several classes are looked at, block against block. A task gives no more links than connect
    its classes, however many pairs reach the threshold.
    """
    placed = _grouped(members, groups, "id")
    mixed_nodes = stored(placed.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo != hi").select("node", "size"))
    dealt = _blocks(placed.join(small(mixed_nodes, 16), "node"), "node", s.block, "component")

    def connect(key: tuple, rows: pa.Table) -> pa.Table:
        of = rows["component"].to_numpy()
        linked = links_among([np.frombuffer(h.as_py(), np.uint64) for h in rows["hashes"]], s.threshold)
        a, b = np.nonzero(linked & (of[:, None] < of[None, :]))
        found = spanning(np.unique(np.stack([of[a], of[b]], 1), axis=0).tolist())
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.join(sets, "id").select("node", "i", "j", "component", "hashes").groupBy("node", "i", "j").applyInArrow(connect, "a bigint, b bigint").distinct()


def spanning(pairs: list) -> list:
    """As many of the pairs as connect all that the pairs connect."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[y] = x
            kept.append((a, b))
    return kept


def _blocks(placed: DataFrame, group: str, block: int, *more: str) -> DataFrame:
    """Each member of a group (with its `size`) once for every block of the group, its own block in `own`, the pair of blocks in (i, j)."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = placed.select("id", group, *[c for c in more if c != group], blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def _hashed(s: Settings):
    """A column function: the sorted hashes of a text's n-grams, as bytes; their MD5 is the set key."""
    words = s.words

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in texts], dtype=object)

    return hashed


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, hashes) of the wanted sets (id, set_key, rep), from the whole texts of the rows that carry the id `rep`."""
    wanted = stored(wanted)
    # rows without an id count as id -1 here: a few more texts may be hashed than are wanted, none fewer
    carriers = wanted.select(F.coalesce("rep", F.lit(-1)).alias("carrier")).distinct()
    texts = _source(docs, id_col, text_col).join(small(carriers, 16), F.coalesce("id", F.lit(-1)) == F.col("carrier"), "left_semi").select("text")
    words = s.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                hashes = [shingles(t.as_py(), words).tobytes() for t in part["text"]]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(h).digest() for h in hashes], pa.binary()), pa.array(hashes, pa.binary())], ["set_key", "hashes"])

    # no column function: the join's filter on the key would go below it and hash every text a second time, in a second worker
    found = texts.mapInArrow(run, "set_key binary, hashes binary").groupBy("set_key").agg(F.first("hashes").alias("hashes"))
    return found.join(wanted.select("id", "set_key"), "set_key").select("id", "hashes")


def _link_counts(groups: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(id, n_links) for every id of `groups`: links inside each component, counted block against block."""
    sizes = stored(groups.groupBy("component").agg(F.count("*").alias("size")))
    placed = groups.join(small(sizes, 16), "component")
    pairs_of_two = placed.filter("size = 2").select("id", F.lit(1).cast("long").alias("n_links"))
    dealt = _blocks(placed.filter("size > 2"), "component", s.block).join(sets, "id").select("id", "hashes", "own", "component", "i", "j")

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        ids, own = rows["id"].to_numpy(), rows["own"].to_numpy()
        linked = links_among([np.frombuffer(h.as_py(), np.uint64) for h in rows["hashes"]], s.threshold)
        if key[1].as_py() != key[2].as_py():  # two blocks: only pairs across
            linked &= own[:, None] != own[None, :]
        return pa.table({"id": ids, "n_links": linked.sum(1).astype(np.int64)})

    counted = dealt.groupBy("component", "i", "j").applyInArrow(count, "id bigint, n_links bigint").groupBy("id").agg(F.sum("n_links").alias("n_links"))
    return counted.unionByName(pairs_of_two)


def links_among(sets: list[np.ndarray], threshold: float, columns: int = 4096) -> np.ndarray:
    """Which pairs of the sets reach the threshold, from products of their incidence matrix, some columns at a time."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, of, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1  # the others are in no intersection
    column = np.cumsum(shared) - 1
    keep = shared[of]
    rows, at = rows[keep], column[of[keep]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(at, [start, start + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[rows[lo:hi], at[lo:hi] - start] = 1
        common += part @ part.T
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def deduplicate(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, whole, of which one document of each class stays: the one of the smallest id (nulls last).

    Rows are told apart by id and n-gram set. Rows that repeat both stay together; exact deduplication takes care of
    them. Of rows that share an id but not a set each goes or stays with its own class. Texts without words are one
    class. An empty table gives an empty result.
    """
    rows, named = _named(docs, s, id_col, text_col)
    fate = rows.join(small(named, 80), "set_key", "left")
    goes = F.col("named").isNotNull() & ~(F.col("stays") & F.col("id").eqNullSafe(F.col("class_id")))
    marked = fate.select("id", "set_key", F.coalesce(goes, F.lit(False)).alias("goes"))
    ids = stored(marked.groupBy("id").agg(F.bool_and("goes").alias("all"), F.bool_or("goes").alias("any")).filter("any").select(F.col("id").alias("gone"), "all"))
    own = F.col(id_col).cast("long")

    listed, nulls_too = ids.filter("gone is not null"), not ids.filter("gone is null").isEmpty()
    whole = docs.join(small(listed, 16), own == F.col("gone"), "left_anti")
    mixed_ids = stored(listed.filter("not all"))
    if mixed_ids.isEmpty() and not nulls_too:
        return whole
    # rows without an id, and ids of which some texts go and some stay, are told apart by their sets
    touched = docs.join(small(mixed_ids, 16), own == F.col("gone"), "left_semi")
    if nulls_too:
        whole, touched = whole.filter(own.isNotNull()), touched.unionByName(docs.filter(own.isNull()))
    some = ids.filter("gone is null or not all").select("gone")
    pairs = stored(marked.filter("goes").join(small(some, 16), F.col("id").eqNullSafe(F.col("gone")), "left_semi").select("id", "set_key").distinct())
    packed = touched.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("own"), text_of(text_col).alias("text"))
    keyed = small_batches(packed).withColumn("own_key", F.unhex(F.md5(_hashed(s)("text"))))
    return whole.unionByName(keyed.join(small(pairs, 40), F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("set_key")), "left_anti").select("row.*"))
