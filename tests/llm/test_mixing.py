import math
import random
from collections import Counter

import pytest

from holdfast.llm import mixing
from holdfast.llm.mixing import Mix


def make(n=4000, hot=0.4, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", "d", None])
        out.append((i, " ".join(["w"] * rng.randint(1, 40)), source))
    return out


def tokens_by(rows):
    out = Counter()
    for _, t, s in rows:
        out[s] += len((t or "").split())
    return out


def test_weights_meet_the_entropy(docs):
    rows = make()
    share = {s: n / sum(tokens_by(rows).values()) for s, n in tokens_by(rows).items()}
    mix = Mix(entropy=0.97, passes=50, budget=1.0)
    got = {r["source"]: r["weight"] for r in mixing.schedule(docs(rows), mix).select("source", "weight").distinct().collect()}

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    lo, hi = 0.0, 1.0
    for _ in range(50):
        a = (lo + hi) / 2
        lo, hi = (a, hi) if -sum(w * math.log(w) for w in weights(a).values()) >= 0.97 * math.log(len(share)) else (lo, a)
    assert got == {s: pytest.approx(w, abs=3e-6) for s, w in weights(lo).items()}


def test_repetition_limit_wins(docs):
    rows = make()
    totals, got = tokens_by(rows), Counter()
    for r in mixing.schedule(docs(rows), Mix(entropy=1.0, passes=1.5, budget=1.0)).collect():
        got[r["source"]] += r["n_tokens"]
    assert max(got[s] / totals[s] for s in totals) == pytest.approx(1.5, abs=0.02)
    assert sum(got.values()) == pytest.approx(sum(totals.values()), rel=0.01)


def test_blocks_are_budgeted_permutations(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    rows = make()
    got = [r.asDict() for r in mixing.schedule(docs(rows), Mix(entropy=1.0, passes=9, budget=1.2)).collect()]
    totals, uses = tokens_by(rows), Counter()
    seen = set()
    places = {}
    for r in got:
        uses[r["source"]] += r["n_tokens"]
        assert (r["doc_id"], r["epoch"]) not in seen
        seen.add((r["doc_id"], r["epoch"]))
        places.setdefault((r["source"], r["epoch"], r["block"]), []).append(r["place"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    for s in totals:
        assert uses[s] == pytest.approx(1.2 * sum(totals.values()) / len(totals), rel=0.02)
    # full passes use every row of the source
    for s, n in Counter(r[2] for r in rows).items():
        whole = int(1.2 * sum(totals.values()) / len(totals) / totals[s])
        for e in range(whole):
            assert sum(r["source"] == s and r["epoch"] == e for r in got) == n


def test_every_row_at_least_once(docs):
    rows = make(1500)
    out = mixing.mixed(docs(rows), Mix(entropy=0.95, passes=1.5, budget=None))
    assert out.columns == docs(rows).columns
    times = Counter(r["doc_id"] for r in out.collect())
    assert set(times) == {r[0] for r in rows} and max(times.values()) == 2
    assert all(times[r[0]] == 1 for r in rows if r[2] == "hot")


def test_same_rows_for_any_layout(docs):
    given = docs(make(800))
    mix = Mix(entropy=0.99, passes=4, budget=1.0)
    assert sorted(map(tuple, mixing.schedule(given, mix).collect()), key=repr) == sorted(map(tuple, mixing.schedule(given.repartition(13), mix).collect()), key=repr)


def test_odd_tables(docs):
    assert mixing.schedule(docs([])).count() == 0 and mixing.mixed(docs([])).count() == 0
    empty = [(1, None, "a"), (2, "", "b"), (2, "", "b")]
    assert sorted(r["doc_id"] for r in mixing.schedule(docs(empty)).collect()) == [1, 2, 2]
    one = [(1, "x y", "a"), (None, "x", "a"), (3, "word " * 100_000, "a"), (4, "", "zero")]
    assert mixing.mixed(docs(one)).count() == 4
    with pytest.raises(ValueError):
        mixing.schedule(docs(one), Mix(budget=5.0, passes=4.0))


def test_no_python_on_the_main_path(docs):
    plan = mixing.schedule(docs(make(50)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
