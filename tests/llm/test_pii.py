import random
import time
import re

import pytest
from pyspark.sql import functions as F

from holdfast.llm import pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("letters", ["a@.-_ +1é", "12.+ ()-9a", "0123456789 -", "255.1 a@b"])
def test_base_spans(letters):
    rng = random.Random(3)
    for _ in range(8000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 2_000_000, "a@" * 500_000, "1" * 2_000_000, "1." * 500_000, "+1" * 500_000):
        pii.base_spans(t)


def test_many_mentions_in_a_long_text_take_linear_time():
    for t in ("1.1.1.1 " * 125_000, "a@b.de " * 140_000, ("word " * 20 + "1.1.1.1 ") * 9_000):
        began = time.process_time()
        found = list(pii.contexts(t, pii.base_spans(t), pii.WINDOW))
        assert len(found) >= 9_000 and time.process_time() - began < 5


def test_contexts_against_a_recount():
    """Words around each mention from a plain list of all words."""
    rng = random.Random(6)
    for _ in range(300):
        t = " ".join(rng.choice(["word", "Other", "a@b.de", "1.1.1.1", "x", "4111111111111111", "+49 170 1234567", "word-two", "é", "naïve9name"]) for _ in range(rng.randrange(30)))
        spans = pii.base_spans(t)
        free = [m for m in re.finditer(r"[^\W\d_]{2,}", t) if not any(s < m.end() and m.start() < e for _, s, e in spans)]
        want = [(pii.entity(k, t[s:e]), sorted({m[0].lower() for m in [m for m in free if m.end() <= s][-3:] + [m for m in free if m.start() >= e][:3]})) for k, s, e in spans]
        assert list(pii.contexts(t, spans, 3)) == want


def corpus():
    """bo@x.org is always next to `zyx`; `the` is everywhere; `rare` stands next to it once, as often as copies repeat it."""
    words = "alpha beta gamma delta epsilon".split()
    rows = [(i, f"the {words[i % 5]} zyx bo@x.org {words[(i * 3) % 5]} the end{'' if i else ' rare'}") for i in range(6)]
    rows += [(10 + i, "the rare copies al@x.org of qwv one text") for i in range(6)]
    rows += [(100 + i, " ".join(words[(i * j) % 5] for j in range(9)) + " the other text without any entity, rare or not, to the end") for i in range(200)]
    return rows


def test_revealing_terms(docs):
    got = {(r["entity"], r["term"]) for r in pii.revealing_terms(docs(corpus())).collect()}
    assert got == {("email:bo@x.org", "zyx")}


def test_find(docs):
    rows = corpus() + [(900, "zyx without the entity"), (901, None), (902, ""), (None, "bo@x.org zyx"), (0, "second row of one id zyx")]
    found = pii.find(docs(rows))
    spans = {(r["doc_id"], r["text"]): [tuple(s) for s in r["spans"]] for r in found.collect()}
    assert spans[1, rows[1][1]] == [("email", 13, 21), ("generalised", 9, 12)]
    assert spans[900, "zyx without the entity"] == [] and spans[901, ""] == [] and spans[0, "second row of one id zyx"] == []
    assert spans[None, "bo@x.org zyx"] == [("email", 0, 8), ("generalised", 9, 12)]
    assert all(not s for (i, _), s in spans.items() if i and 100 <= i < 800)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(found.filter(F.col("doc_id") == 1)).collect()}
    assert clean[1] == "the beta [TERM] [EMAIL] delta the end"
    digest = {r["doc_id"]: r for r in pii.digests(found).filter("doc_id = 1").collect()}[1]
    assert digest["spans"] == "email:13:21,generalised:9:12" and digest["n_email"] == 1 and digest["n_terms"] == 1 and digest["n_card"] == 0


def test_terms_that_reveal_wholly_are_removed(docs):
    found = pii.find(docs(corpus())).filter("doc_id = 1").collect()[0]
    assert [tuple(x) for x in found["spans"]] == [("email", 13, 21), ("removed", 9, 12)]


def test_one_mention_reveals_a_term_that_is_nowhere_else(docs):
    filler = [(1000 + i, "the words of the other text " * 40) for i in range(400)]
    rows = corpus() + filler + [(901, "the lonely words of Quarx qu@x.org the text")]
    got = {(r["entity"], r["term"]) for r in pii.revealing_terms(docs(rows)).collect()}
    assert {("email:qu@x.org", "quarx"), ("email:qu@x.org", "lonely"), ("email:bo@x.org", "zyx")} <= got
    assert not {t for _, t in got} & {"the", "words", "of", "text", "other", "rare", "alpha"}
    spans = pii.find(docs(rows)).filter("doc_id = 901").collect()[0]["spans"]
    assert ("removed", 20, 25) in [tuple(x) for x in spans]


def test_empty(docs):
    assert pii.find(docs([])).count() == 0
