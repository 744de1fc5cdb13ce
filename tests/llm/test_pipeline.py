import json

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftstone.llm import decontaminate, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        result = corpus_pipeline.written(f(spark, docs, SF))
        out.append((name, docs, result))
        docs = result
    return {n: (a, b) for n, a, b in out}


def test_order_and_columns(spark, stages):
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(b.columns == columns for n, (_, b) in stages.items() if n != "mixing")
    assert stages["mixing"][1].columns == [*columns, "copies"]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_is_its_operator(spark, stages):
    before, after = stages["toxicity"]
    scored = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet")))
    assert ids(after) == ids(scored.where("score < 0.5")) and len(ids(after)) < len(ids(before))
    before, after = stages["near_duplicates"]
    assert ids(after) == ids(simhash.stage(spark, before, SF)) and len(ids(after)) < len(ids(before))
    before, after = stages["decontamination"]
    leaks = decontaminate.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(leaks) > 0")
    assert set(ids(before)) - set(ids(after)) == set(ids(leaks)) and leaks.count()
    before, after = stages["secrets"]
    texts, scan = {r.doc_id: r.text for r in before.collect()}, secrets.Scanner(secrets.automata())
    for r in after.collect():
        was, now = (scan(pa.array([x], pa.string())).get(0, []) for x in (texts[r.doc_id], r.text))
        assert (r.text == texts[r.doc_id]) == (not was) and not any(secrets.RULES[k].base for _, k, _ in now)
        assert r.n_chars == (len(r.text) if r.text is not None else None)
    before, after = stages["mixing"]
    assert after.where("copies < 1 OR copies > 2").isEmpty()


def test_run_gives_the_same(spark, stages):
    rows = lambda df: sorted(json.dumps(r.asDict()) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages["mixing"][1])


def test_stages_take_odd_and_empty_documents(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES:
        for docs in (odd.withColumn("n_chars", F.length("text")), empty):
            assert set(docs.columns) <= set(stage(spark, docs, SF).columns)
            stage(spark, docs, SF).collect()
