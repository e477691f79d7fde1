import hashlib

import pytest
from pyspark.sql import functions as F

from holdfast.llm.exact_dedup import deduplicate, exact_groups

ROWS = [(1, "a b"), (2, "a b"), (3, "a b "), (4, None), (5, ""), (6, "c" * 200_000), (7, "c" * 200_000), (7, "c" * 200_000), (None, "a b"), (None, "only null"), (8, "A b")]


def brute(rows, pick):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        ids = [j for j in same if j is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def weak(text):
    """Two texts of equal length collide."""
    return F.unhex(F.md5(F.length(text).cast("string")))


@pytest.mark.parametrize("keep,pick", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("digest", [None, weak])
def test_groups(docs, keep, pick, digest):
    more = {"digest": digest} if digest else {}
    got = exact_groups(docs(ROWS), keep=keep, **more)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS, pick)


@pytest.mark.parametrize("digest", [None, weak])
def test_deduplicate_keeps_whole_rows(docs, digest):
    given = docs(ROWS)
    got = deduplicate(given, **({"digest": digest} if digest else {}))
    assert got.columns == given.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, "a b"), (3, "a b "), (4, None), (6, "c" * 200_000), (None, "only null"), (8, "A b")], key=repr)


def test_empty(docs):
    assert exact_groups(docs([])).count() == 0
    assert deduplicate(docs([])).count() == 0
