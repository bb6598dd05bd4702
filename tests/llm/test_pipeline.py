import pytest
from samples import ODD_TEXTS

import corpus_pipeline
from riskframe.llm import hyperminhash, personal_data
from riskframe.llm.tables import n_words, table, written


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    """The rows before and after every stage."""
    docs, out = table(spark, sf_small, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_small))
        out[name] = (docs, after)
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns
    assert {"doc_id", "sequence_id", "offset"} <= set(stages["packed"][1].columns)


def test_quality_keeps_good_documents(spark, sf_small, stages):
    before, after = stages["good_quality"]
    labels = table(spark, sf_small, "labels")
    gone = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    kept = after.join(labels, "doc_id")
    assert gone.filter("quality = 1").count() <= 0.01 * kept.count()
    assert kept.filter("quality = 0").count() <= 0.1 * gone.count() + 3


def test_one_document_of_each_group_stays(stages):
    before, after = stages["one_of_each"]
    groups = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(before, 5, 80).collect()}
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(set(groups.values()))


def test_no_personal_data_is_left(stages):
    before, after = stages["without_personal_data"]
    texts = {r.doc_id: r.text for r in before.collect()}
    changed = 0
    for r in after.collect():
        assert personal_data.base_spans(r.text) == [] and r.n_chars == len(r.text)
        if r.text != texts[r.doc_id]:
            changed += 1
        else:
            assert personal_data.base_spans(texts[r.doc_id]) == []
    assert 0 < changed < len(texts)


def test_mix_repeats_whole_documents(stages):
    before, after = stages["mixed_sources"]
    texts = {(r.doc_id, r.text) for r in before.collect()}
    seen = {}
    for r in after.collect():
        assert (r.doc_id, r.text) in texts
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert max(seen.values()) <= 3
    assert after.select("source").distinct().count() == before.select("source").distinct().count()


def test_packed_rows_fill_sequences(stages):
    before, after = stages["packed"]
    sequences = {}
    for r in after.collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert after.filter("piece = 0").count() == before.count()


def test_odd_rows_and_empty_tables(spark, make_docs, sf_dir):
    for rows in (ODD_TEXTS, []):
        docs = make_docs(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir))
        docs.collect()


def test_wordless_documents_have_no_words(make_docs):
    assert [r[0] for r in make_docs([(1, None), (2, " \n")]).select(n_words("text")).collect()] == [0, 0]
