"""The pipeline's stages beside brute force, and the whole run."""
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline as pipeline
from nocturne.llm import quality
from nocturne.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        out.append(docs.collect())
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_all_but_the_last_return_documents(stages):
    assert len(stages[0]) == 200
    for rows in stages[1:-1]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r.n_chars == len(r.text) for r in rows)
        first = {r.doc_id: r for r in stages[0]}
        assert all((r.lang, r.source) == (first[r.doc_id].lang, first[r.doc_id].source) for r in rows)


def test_quality_stage(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(texts(stages[1]))
    assert np.mean([(d in kept) == bool(q) for d, q in labels.items()]) >= 0.98
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert kept == {r.doc_id for r in scored if r.kept}
    assert all(texts(stages[0])[d] == t for d, t in texts(stages[1]).items())


def test_line_stage(stages):
    want = brute.line_dedup([(r.doc_id, r.text) for r in stages[1]], exact_chars=1)
    assert texts(stages[2]) == {d: t for d, (t, _, n, _) in want.items() if not (n and not t.strip(" "))}
    assert any(n for _, _, n, _ in want.values())


def test_whole_line_stage(spark):
    """Three edits, which the line stage of ``STAGES`` leaves, and repeats of short lines."""
    long = "A plain sentence about the house and the garden."
    near = long.replace("plain", "plane").replace("garden", "gardens")  # three edits
    rows = [(1, long + "\nLes.\n}", "en", "s", 0), (2, near + "\nLes.\nnew", "en", "s", 0), (3, "}\nLes.", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(pipeline.WHOLE_STAGES)["line dedup"]
    assert texts(stage(spark, docs, SF).collect()) == {1: long + "\nLes.\n}", 2: "new"}
    assert texts(dict(pipeline.STAGES)["line dedup"](spark, docs, SF).collect()) == {1: long + "\nLes.\n}", 2: near + "\nnew"}


def test_near_duplicate_stage(stages):
    want = brute.near_duplicates([(r.doc_id, r.text) for r in stages[2]], 80)
    assert texts(stages[3]) == {d: t for d, t in texts(stages[2]).items() if want[d][1] == d}


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.decontamination([(r.doc_id, r.text) for r in stages[3]], items)
    before, after = texts(stages[3]), texts(stages[4])
    assert set(after) == {d for d, w in want.items() if not w[4]}
    assert all(t == before[d] for d, t in after.items() if not want[d][1])
    again = brute.decontamination(list(after.items()), items)
    assert all(again[d][1] == 0 for d in after)


def test_packing_stage(stages):
    plain = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    sizes = {d: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts(stages[4]).items()}
    got, used = {}, {}
    for r in stages[5]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert got == sizes and max(used.values()) <= pipeline.CAPACITY
    assert len(used) <= -(-sum(sizes.values()) // pipeline.CAPACITY) * 1.03 + 2


def test_run(spark, stages):
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, pipeline.run(spark, SF).collect())) == sorted(map(key, stages[5]))


def test_empty_and_odd_documents(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, TEXT string"
    words = "A plain sentence about the house, and then another of the kind. " * 6
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, words, "en", "s", 9, "x"), (3, words, "en", "s", 9, "x"), (3, words, "en", "s", 9, "x"), (4, words + " end", None, "s", 9, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, columns)
        for _, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF))
        ids = {r.doc_id for r in docs.collect()}
        assert ids == ({1, 2, 3, None} if data else set())
