"""The pipeline against a plain version of each stage, stage by stage on what the one before kept."""

from collections import Counter

import corpus_pipeline
import numpy as np
from test_near_dup import brute as classes_of
from test_suffixes import windows

from ferrule.llm.quality import quality_scores
from ferrule.llm.sources import table, vocabulary


def without_repeats(docs: dict, size: int = 200) -> dict:
    texts = {k: t.encode() for k, t in docs.items()}
    count = windows(list(texts.values()), size)
    out = {}
    for k, b in texts.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = True
        at, kept = 0, []
        for c in docs[k]:
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        out[k] = "".join(kept)
    return out


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    assert 0 < len(good) < len(texts)
    texts = {k: t for k, t in texts.items() if k in good}
    texts = {k: texts[k] for k, c in classes_of(texts).items() if k == c}
    texts = without_repeats(texts)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = Counter({k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in texts.items()})
    got: Counter = Counter()
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
    assert got == expected


def test_stages_return_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert sorted(out.dtypes) == sorted(docs.dtypes)
