import hashlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from holdfast.llm import toxicity
from holdfast.llm.common import stored, table
from tests.conftest import SF_DIR
from tests.llm.test_jaccard_join import brute


def test_stages_against_brute_force(spark):
    docs = table(spark, SF_DIR, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "bpe"]
    kept = [{r["doc_id"]: r for r in docs.collect()}]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        frame = stored(stage(spark, frame, SF_DIR))
        assert frame.columns == docs.columns
        kept.append({r["doc_id"]: r for r in frame.collect()})
    given, clean, exact, near = kept
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, table(spark, SF_DIR, "labels")).collect()}
    assert set(clean) == {i for i, p in scores.items() if not p}
    first = {}
    for i in sorted(clean):
        first.setdefault(clean[i]["text"], i)
    assert set(exact) == set(first.values())
    assert set(near) == {i for i, (c, *_) in brute([(i, r["text"]) for i, r in exact.items()]).items() if i == c}
    mixed = stored(corpus_pipeline.STAGES[3][1](spark, frame, SF_DIR))
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) == set(near)
    out = corpus_pipeline.STAGES[4][1](spark, mixed, SF_DIR).collect()
    assert Counter(r["doc_id"] for r in out) == times
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in out[:40]:
        ids = library.encode(near[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
