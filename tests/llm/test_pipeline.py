"""The pipeline's stages against brute force, each on its own input."""

import re
from collections import Counter

import corpus_pipeline
from tenderline.llm import bpe
from tenderline.llm.common import materialize, table

from . import cases
from .test_dedup import exact_brute, jaccard_brute
from .test_text import counts


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "jaccard_join", "mixing", "bpe"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(spark, stage(spark, docs, sf_dir), f"test-{name}")
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "bpe":
            assert out.columns == columns
            after = [(r.doc_id, r.text) for r in out.collect()]
        if name == "quality_rules":
            kept = Counter(after)
            assert not kept - Counter(before)
            for i, t in before:
                n, *_, rep = counts(t)
                assert not (n < 20 or 100 * rep > 30 * n) or (i, t) not in kept
            labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
            good = [x for x in before if labels.get(x[0]) == 1 and counts(x[1])[0] >= 20 and 100 * counts(x[1])[4] <= 30 * counts(x[1])[0]]
            assert sum(x in kept for x in good) >= 0.98 * len(good)
        elif name == "exact_dedup":
            assert sorted(i for i, _ in after) == sorted(i for (i, _, _, stays, _), n in exact_brute(before).items() if stays for _ in range(n))
        elif name == "jaccard_join":
            assert sorted(i for i, _ in after) == sorted({c for (_, _, c) in jaccard_brute(before, 5, 80, 100)})
        elif name == "mixing":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 3
            total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in before)
            assert abs(sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in after) - total) < 0.3 * total
        else:
            v = bpe.vocabulary()
            want = Counter((i, tuple(x)) for (i, _), x in zip(before, v.encode([t for _, t in before]).to_pylist(), strict=True))
            assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == want
        docs = out
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == docs.columns and Counter(r.ids_sha256 for r in whole.collect()) == Counter(r.ids_sha256 for r in docs.collect())


def test_odd_rows(spark, sf_dir):
    for docs in (cases.frame(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(spark, stage(spark, docs, sf_dir), f"odd-{name}")
            if name != "bpe":
                assert out.columns == docs.columns
            docs = out
        docs.count()


def test_chained_without_a_write(spark, sf_dir):
    """Stages may be chained lazily, and two pipelines in one process leave each other's tables alone."""
    docs = table(spark, sf_dir, "documents")
    stages = [f for _, f in corpus_pipeline.STAGES]
    one, other = docs, docs.where("doc_id % 2 = 0")
    want = stages[3](spark, materialize(spark, stages[2](spark, materialize(spark, stages[1](spark, docs, sf_dir), "a"), sf_dir), "b"), sf_dir).count()
    for stage in stages[1:4]:
        one, other = stage(spark, one, sf_dir), stage(spark, other, sf_dir)
    assert one.count() == want and other.count() > 0
    assert stages[3](spark, stages[2](spark, stages[1](spark, docs, sf_dir), sf_dir), sf_dir).count() == want
