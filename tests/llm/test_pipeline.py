"""The pipeline against its operators run one by one on a small table."""

import corpus_pipeline
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_operators import SF, check_packed
from vellum.llm import fertility, ordinal, packing
from vellum.llm.shared import table, vocabulary_path


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    model = ordinal.train(docs, ordinal.graded(table(spark, SF, "labels")))
    scores = {r.doc_id for r in ordinal.score(docs, model).where(ordinal.selected()).collect()}
    sound = {r.doc_id for r in fertility.quality_rules(docs).where("kept").collect()} & scores
    left = docs.where(docs.doc_id.isin(list(sound)))
    first = brute_kept({r.doc_id: r.text for r in left.collect()})
    stage = docs
    for (_, run), want in zip(corpus_pipeline.STAGES[:3], (scores, sound, first)):
        stage = run(spark, stage, SF)
        assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == sorted(want)
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    kept = stage.collect()
    check_packed(packing.pack(stage).collect(),
                 {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in kept})
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == first
    assert sum(r.length for r in rows) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept)
