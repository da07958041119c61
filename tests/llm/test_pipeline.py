"""The pipeline's stages, each against brute force on its own input."""

import struct
from collections import Counter

import pytest

import corpus_pipeline
from lectern.llm import fertility, mixing, simhash, toxicity
from lectern.llm.common import stored
from tests.llm.test_groups import brute_components, brute_fingerprint

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, small_docs, labels):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = small_docs
    outputs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        outputs.append(docs)
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    for df in outputs[:-1]:
        assert df.columns == small_docs.columns
    good = {r.doc_id for r in fertility.judge(small_docs).collect() if r.kept}
    assert ids(outputs[0]) == Counter(good)
    clean = {r.doc_id for r in toxicity.scores(outputs[0], labels).collect() if r.predicted == 0}
    assert ids(outputs[1]) == Counter(clean)
    rows = outputs[1].collect()
    values = [brute_fingerprint(r.text) for r in rows]
    assert ids(outputs[2]) == Counter(set(brute_components(values, [r.doc_id for r in rows])))
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(outputs[2]).collect()}
    assert ids(outputs[3]) == Counter({d: n for d, n in times.items() if n})
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    from lectern.llm.byte_bpe import byte_bpe

    encoded = outputs[4].collect()
    assert Counter(r.doc_id for r in encoded) == ids(outputs[3])
    for r in encoded:
        numbers = struct.unpack(f"<{r.n_tokens}I", r.ids)
        assert byte_bpe().decode(numbers) == texts[r.doc_id].encode()


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "n_tokens", "ids"] and rows.count() > 0


@pytest.mark.parametrize("number", range(5))
def test_odd_input(spark, odd_docs, no_docs, number):
    _, stage = corpus_pipeline.STAGES[number]
    assert stage(spark, no_docs, FOLDER).count() == 0
    found = stage(spark, odd_docs, FOLDER)
    if number < 4:
        assert found.columns == odd_docs.columns
    known = {r.doc_id for r in odd_docs.collect()}
    assert {r.doc_id for r in found.collect()} <= known


def test_rows_that_share_a_doc_id(spark, small_docs):
    """Each row is kept for its own text, whatever rows share its doc_id, and whether it has one."""
    judged = {r.doc_id: r.kept for r in fertility.judge(small_docs).collect()}
    rows = small_docs.collect()
    good, bad = [r for r in rows if judged[r.doc_id]], [r for r in rows if not judged[r.doc_id]]
    shared, nameless = good[0].doc_id, good[1].doc_id
    names = {bad[0].doc_id: shared, nameless: None}
    docs = spark.createDataFrame([(names.get(r.doc_id, r.doc_id), *r[1:]) for r in rows], small_docs.schema)
    assert Counter(r.text for r in fertility.keep(docs).collect()) == Counter(r.text for r in good)

    other = " ".join(f"other{i * i}" for i in range(60))
    copies = " ".join(f"copy{i * 7}" for i in range(60))
    texts = [(1, "one two three four"), (1, other), (None, copies), (None, copies), (None, "five six seven eight"), (2, "one two three four"), (3, other), (4, other), (4, other)]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in texts], small_docs.schema)
    found = Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert found == Counter([(1, "one two three four"), (1, other), (None, copies), (None, "five six seven eight")])
