import numpy as np
import pytest

import corpus_pipeline
from tesserae.llm import fuzzy_lines, tokens

from .fixtures import documents, empty
from .test_operators import brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or kept[-1].columns == COLUMNS
    frames = [df.toPandas() for df in kept]

    assert set(frames[1].doc_id) == {r.doc_id for r in frames[0].itertuples() if any(c.isalpha() for c in r.text or "")}
    before, after = frames[1].set_index("doc_id").text, frames[2].set_index("doc_id").text
    seen = set()
    for i in sorted(before.index):
        own = [line for _, line in fuzzy_lines.normalised_lines(before[i] or "")]
        left = [line for _, line in fuzzy_lines.normalised_lines(after.get(i, "") or "")]
        assert len(left) == len(set(left)) and not seen & set(left) and set(left) <= set(own)
        seen |= set(left)
    components = brute_components(list(frames[2][["doc_id", "text"]].itertuples(index=False)))
    assert set(frames[3].doc_id) == {i for i, (_, c) in components.items() if i == c}
    assert sorted(map(tuple, frames[3].astype(str).to_numpy())) == sorted(map(tuple, frames[4].astype(str).to_numpy()))
    encode = tokens.byte_pairs().tokenizer.encode
    pieces = frames[5].groupby("doc_id").length.sum()
    assert pieces.to_dict() == {r.doc_id: len(encode(r.text or "", add_special_tokens=False).ids) + 1 for r in frames[4].itertuples()}
    assert np.all(frames[5].groupby("sequence_id").length.sum().sort_index()[:-1] == 2048)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)


@pytest.mark.parametrize("make", [documents, empty])
def test_stages_on_odd_rows(spark, tmp_path, make):
    docs = make(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k == 4:
            break
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        # what stays has its own values in all further columns
        assert after.where("node <> concat('node of ', doc_id) or score <> concat('score of ', doc_id) or n_lines <> concat('n_lines of ', doc_id)").count() == 0
        docs = after
    assert (after.count() == 0) == (make is empty)
