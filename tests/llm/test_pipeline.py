"""The pipeline against its stages done one document after the other."""

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_free import check_packing
from tracelat.llm import line_frequency, pseudonyms
from tracelat.llm.queries import KEY


def test_stages_and_run(spark, sf_dir, docs, vocabulary):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    kept = []
    for (d, t, _), (_, _, _, good, gone) in zip(rows, brute.quality(rows, line_frequency.MAX_DOCS, line_frequency.MAX_SHARE)):
        if good:
            kept.append((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)))
    of = brute.components(kept, 5)
    kept = [(d, brute.pseudonymised(t, pseudonyms.KINDS, KEY)) for d, t in kept if of[d] == d]
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), kept, vocabulary("word_bpe_49k.json"))


def test_stages_keep_columns_and_edge_rows(spark, edges, empty):
    for name, stage in corpus_pipeline.STAGES:
        for df in (edges, empty):
            out = stage(spark, df, "")
            assert (name == "packing") or out.columns == df.columns
            n = out.count()
            assert n == 0 if df is empty else n > 0
    pii = {r.doc_id: r for r in corpus_pipeline.pii(spark, edges, "").collect()}
    assert pii[1].text is None and pii[1].n_chars is None and pii[11].n_chars == len(pii[11].text)
