import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from holdfast.llm import conversations as C

ROWS = "conv_id bigint, turn bigint, role string, text string, copies int, cost string, audit string, part string, row string, pos string, key string, block string"


@pytest.fixture
def talks(spark):
    """Makes a conversations table of (conv_id, turn, role, text) with columns whose names the operator uses inside."""

    def make(rows, copies=1):
        return spark.createDataFrame([(*r, copies, "c", "a", "p", "r", "q", "k", "b") for r in rows], ROWS)

    return make


def cheapest(rows):
    """(cost, audit, repaired) by trying every string of edits with at most two insertions in a gap."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    gaps = [[("I" * len(x), [(r, "") for r in x], 5 * len(x)) for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]] * (len(rows) + 1)
    choices = []
    for (role, text), fault in zip(rows, faults):
        own = [("D", [], 2)]
        if fault not in ("b", "d"):
            more = 5 * (fault == "t")
            own += [("K", [(role, text)], more)] + [("R", [(r, text)], 1 + more) for r in ("user", "assistant")]
        choices.append(own)
    best = None
    for gap in itertools.product(*gaps):
        for own in itertools.product(*choices):
            edits = [e for pair in itertools.zip_longest(gap, own) for e in pair if e is not None]
            out = [r for _, rs, _ in edits for r in rs]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                value = sum(c for *_, c in edits), "".join(a for a, *_ in edits)
                if best is None or value < best[:2]:
                    best = *value, out
    return best, faults


def some_rows(rng, n):
    roles, texts = ["user", "user", "assistant", "system", "tool", "", "usher", "agent"], ["a.", "b!", "c?", "cut", "", " \t", "d.\n", "e. \x0b", "x\xa0", "a."]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_lightest_derivation_against_all_edit_strings():
    rng = random.Random(3)
    for n in [0, 1, 2, 3] * 60:
        rows = some_rows(rng, n)
        (cost, audit, out), faults = cheapest(rows)
        code = {"": C.NONE, "b": C.BLANK, "d": C.DUPLICATE, "t": C.TRUNCATED}
        found = C.lightest([(r[:1], code[f]) for (r, _), f in zip(rows, faults)], C.START, C.FINAL, C.Costs())
        assert min(found.values()) == (cost, audit), rows
        assert C.apply(audit, rows) == out


def expected(rows):
    """The contract in plain Python, with the search of one block only."""
    convs = {}
    for conv, turn, role, text in rows:
        text, role = (" " if x is None else x for x in (text, role))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append(C.BLANK if not body else C.DUPLICATE if (role, text) in seen else C.TRUNCATED if body[-1] not in ".!?" else C.NONE)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = min(C.lightest(list(zip(initials, faults)), C.START, C.FINAL, C.Costs()).values())
        lines = "\n".join(f"{a}:{b}" for a, b in C.apply(audit, [r[1:] for r in own]))
        turns = {r[0] for r in own} - {None}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in (C.BLANK, C.DUPLICATE, C.TRUNCATED)], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    found = {r["conv_id"]: tuple(r[c] for c in [*C.NAMED, "repaired_sha256"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_tables_short_and_in_blocks(talks):
    rng = random.Random(4)
    rows = [(conv, rng.choice([None, *range(n)]) if rng.random() < 0.2 else i, *some_rows(rng, 1)[0]) for conv in [None, *range(60)] for n in [rng.randrange(1, 12)] for i in range(n)]
    rows += [(99, i % 700, "user" if i % 2 == 0 else "assistant", f"line {i % 900}.") for i in range(1500)]  # one conversation with most rows
    rows += [(None, None, None, None), (7, 3, "user", "same."), (7, 3, "user", "same."), (98, 0, "user", "long " * 100_000 + ".")]
    want = expected(rows)
    assert got(C.digests(C.repair(C.damaged(talks(rows))))) == want
    cut = C.repair(C.damaged(talks(rows)), C.Costs(short=5, block=3))
    assert cut.filter("parts > 1").count() > 100
    assert got(C.digests(cut)) == want


def test_empty_and_dropped(talks):
    assert got(C.digests(C.repair(C.damaged(talks([]))))) == {}
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(C.digests(C.repair(C.damaged(talks([(conv, 0, "user", "hello.")]))))) == {conv: empty}


def test_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = expected([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    found = C.repair(C.damaged(rows))
    assert got(C.digests(found)) == want
    whole = found.select("cost", F.array_join(F.transform("repaired", lambda r: F.substring(r["role"], 1, 1)), "").alias("roles")).collect()
    assert all(re.fullmatch("(s?(ua)+)?", r["roles"]) for r in whole)
