"""Personal data: fixed patterns, and terms that corpus statistics show to reveal a protected entity.

Protected entities are the values that the patterns find. For each entity the terms around its mentions are counted,
and for each term its occurrences in the whole corpus. With p(e) the share of the entity among all words, IC(e) =
-log2 p(e) is what there is to disclose, and PMI(e; t) = log2(p(e|t) / p(e)) what a term next to it discloses. A term
of which PMI / IC reaches a threshold is removed, or from a lower threshold on generalised, in the documents that hold
the entity. Pairs of any count are looked at; those that chance would explain as well are left out by a test.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches, stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of a mention that count as its context.
WINDOW = 8
#: Disclosed share of an entity's information from which a term is removed or generalised, and the probability below
#: which chance must lie to put a term next to an entity in as many different contexts (copies of one context count once).
REMOVE, GENERALISE, LEVEL = 0.97, 0.9, 0.001

#: Different terms that a task counts before it hands them on.
COUNTED = 200_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{2,}")
NO_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part @ domain, found from the @ so that long texts without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        if m := EMAIL_TAIL.match(text, at):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                end = m.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d > "4") for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; a match that fails its test is dropped, not tried again."""
    out = [("email", *s) for s in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, found: str) -> str:
    """The protected value: letters without case, numbers without their separators."""
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else NO_DIGIT.sub('', found)}"


class Covered:
    """Parts of a text, merged where they overlap."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((s, e) for _, s, e in spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.ends) and self.starts[i] < end


def contexts(text: str, spans: list[tuple[str, int, int]], window: int) -> Iterator[tuple[str, list[str]]]:
    """For each mention its entity and the different terms around it, those of other mentions left out.

    The text's words are found once; a mention's neighbours are looked up by place.
    """
    taken = Covered(spans)
    words = [m.span() for m in WORD.finditer(text) if not taken.touches(*m.span())]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    for kind, start, end in spans:
        i, j = bisect_right(ends, start), bisect_left(starts, end)
        yield entity(kind, text[start:end]), sorted({text[a:b].lower() for a, b in words[max(0, i - window) : i] + words[j : j + window]})


def revealing_terms(docs: DataFrame, text_col: str = "text", window: int = WINDOW, generalise: float = GENERALISE, level: float = LEVEL) -> DataFrame:
    """entity, term, disclosure for every pair at or above `generalise` that chance explains with less than `level`, from
    counts over all documents.

    By chance a term that occurs n times stands in as many as n * 2 * window * contexts of the entity / words of the
    corpus of its contexts (Poisson; the tail is bounded after Chernoff). So one mention is enough in a large corpus if
    the term is nearly nowhere else.

    Mentions are first reduced to (entity, context) counts, terms to counts per task, so that a hot entity or word
    costs one row per task.
    """
    texts = docs.select(text_of(text_col).alias("text"))

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [c for t in batch["text"].to_pylist() if (spans := base_spans(t)) for c in contexts(t, spans, window)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["entity", "terms"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for t in batch["text"]:
                counts.update(WORD.findall(t.as_py().lower()))
            if len(counts) > COUNTED:
                yield flushed()
        yield flushed()

    seen = stored(texts.mapInArrow(mentions, "entity string, terms array<string>").groupBy("entity", "terms").agg(F.count("*").alias("n")))
    total = stored(texts.mapInArrow(words, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("term_n")))
    pairs = seen.select("entity", "n", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("pair_n"))
    of_entity = seen.groupBy("entity").agg(F.sum("n").alias("entity_n"), F.count("*").alias("entity_contexts"))
    size = total.agg(F.sum("term_n")).first()[0] or 1
    # a term may stand next to several mentions of one entity; it reveals no more than wholly
    given = F.least(F.lit(1.0), F.col("pair_n") / F.col("term_n"))
    information = -F.log2(F.least(F.lit(0.5), F.col("entity_n") / F.lit(size)))
    scored = pairs.join(total, "term").join(of_entity, "entity").withColumn("disclosure", 1 + F.log2(given) / information)
    # copies of a context count once, for the pair as for the term
    occurs = F.col("contexts") + F.greatest(F.lit(0), F.col("term_n") - F.col("pair_n"))
    chance = occurs * F.col("entity_contexts") * (2.0 * window / size)
    tail = F.col("contexts") - chance + F.col("contexts") * F.log(chance / F.col("contexts"))
    significant = (F.col("contexts") > chance) & (tail < F.log(F.lit(level)))
    return scored.filter((F.col("disclosure") >= generalise) & significant).select("entity", "term", "disclosure")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, remove: float = REMOVE, generalise: float = GENERALISE, level: float = LEVEL) -> DataFrame:
    """One row per input row: id, text, spans (array of kind, start, end; code points, end exclusive).

    Kinds are email, ip, card, phone, then `removed` and `generalised` for revealing terms in texts that hold the
    entity they reveal. Null texts count as empty and have no spans; ids are only carried along, so null and repeated
    ones do no harm. Texts without a protected entity are left alone. An empty table gives an empty result.
    """
    terms = stored(revealing_terms(docs, text_col, window, generalise, level))
    source = small_batches(docs).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    @F.pandas_udf("array<string>")
    def entities(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({entity(k, t[s:e]) for k, s, e in base_spans(t)}) for t in texts], dtype=object)

    # which texts need which terms: entities of each text joined with the few that have terms
    own = terms.withColumn("bytes", F.octet_length("entity") + F.octet_length("term") + 32)
    held = source.select(F.md5("text").alias("key"), F.explode(entities("text")).alias("entity")).join(bounded(own, "bytes").drop("bytes"), "entity")
    listed = F.collect_set(F.struct("term", "disclosure"))
    needed = stored(held.groupBy("key").agg(listed.alias("terms")).withColumn("bytes", F.aggregate("terms", F.lit(64), lambda n, x: n + F.octet_length(x["term"]) + 32)))

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def spans(texts: pd.Series, terms_: pd.Series) -> pd.Series:
        return pd.Series([all_spans(t, terms_at(x), remove) for t, x in zip(texts, terms_, strict=True)], dtype=object)

    rows = source.withColumn("key", F.md5("text")).join(bounded(needed, "bytes").drop("bytes"), "key", "left")
    listed = F.coalesce("terms", F.array().cast("array<struct<term: string, disclosure: double>>"))
    return rows.select(F.col("id").alias(id_col), "text", spans("text", listed).alias("spans"))


def terms_at(listed) -> dict[str, float]:
    out: dict[str, float] = {}
    for x in listed:
        out[x["term"]] = max(x["disclosure"], out.get(x["term"], 0))
    return out


def all_spans(text: str, terms: dict[str, float], remove: float) -> list[dict]:
    out = base_spans(text)
    if terms:
        taken = Covered(out)
        near = [("removed" if terms[w] >= remove else "generalised", *m.span()) for m in WORD.finditer(text) if (w := m[0].lower()) in terms]
        out += sorted((x for x in near if not taken.touches(x[1], x[2])), key=lambda x: (x[0] != "removed", x[1]))
    return [{"kind": k, "start": s, "end": e} for k, s, e in out]


def sanitise(found: DataFrame) -> DataFrame:
    """The result of `find` with its text sanitised: entities and generalised terms become their kind in brackets, removed terms go."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([replaced(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return found.withColumn("text", cleaned("text", "spans"))


def replaced(text: str, spans) -> str:
    out, at = [], 0
    for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= at:
            out += [text[at : x["start"]], "" if x["kind"] == "removed" else "[TERM]" if x["kind"] == "generalised" else f"[{x['kind'].upper()}]"]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and the spans as text, in place of text and spans."""
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"].isin(*KINDS)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    more = F.size(F.filter("spans", lambda x: ~x["kind"].isin(*KINDS))).cast("long").alias("n_terms")
    return found.select(id_col, *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), joined.alias("spans"), more)
