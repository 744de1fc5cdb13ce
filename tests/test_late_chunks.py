"""Late chunks leave a task in small batches, with the pages of before."""

from siftstone.operators import chunking


def test_chunks_of_a_batch_are_not_held_together(spark):
    text = "\n\n".join(f"Paragraph {i} " + "word " * (i % 9 * 20) for i in range(300))
    docs = spark.createDataFrame([(str(i), text * (i % 3), None if i % 2 else "7") for i in range(60)] + [("none", None, None)], "source_id string, text string, page_number string").coalesce(1)
    chunks = chunking.late(docs)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    rows = chunks.collect()
    want = {str(i): list(chunking._packed(text * (i % 3), 300, 100)) for i in range(60)}
    for i, parts in want.items():
        own = sorted((r.chunk_index, r.text, r.chunk_id) for r in rows if r.source_id == i)
        assert own == [(k, x, f"{i}-chunk-{k}") for k, (x, _) in enumerate(parts)]
    assert {r.page_number for r in rows if int(r.source_id) % 2 == 0} == {7} and max(r.page_number for r in rows if int(r.source_id) % 2) > 100
