"""JSON lines with their places."""

import json

import pytest

from siftstone.sources import lines


def test_numbers_go_on_over_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 700), ("b.jsonl", 3), ("c.jsonl", 0)):
        (tmp_path / name).write_text("".join(f'{{"id": "{name[0]}{i}", "t": "{"ä" * (i % 37)}"}}' + ("\r\n" if i % 5 == 0 else "\n") + ("\n" if i % 11 == 0 else "") for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        rows = lines.numbered(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in rows)
    want = [(n, i, x) for n in ("a.jsonl", "b.jsonl") for i, x in enumerate((tmp_path / n).read_text().splitlines(), 1)]
    assert got == sorted(want) and len(got) > 700


BAD = ['{"id": "x", "n": 1} more', "[1]", "nope", '{"id": 5.5, "n": "word"}', '{"n": 1}', '{"id": null}', '{"id": "x", "n": 1, "z": 2}', '{"id": "u"', '"text"', '[{"id": "q", "n": 2}]', '{"id": "x", "n": 1} {"id": "y", "n": 2}', '{"id": "x"}, {"id": "y"}', '{"id": "x"}}, {"y": {"id": "z"}', '{"id": "x"}], [{"id": "z"}', "{'id': 'x'}"]


@pytest.mark.parametrize("bad", BAD)
def test_strict_names_file_and_line(spark, tmp_path, bad):
    good = '\n{"id": "a", "n": 1}\n   \n{"n": null, "id": "b"}\n'
    (tmp_path / "good.jsonl").write_text(good)
    assert sorted(map(tuple, lines.strict(spark, str(tmp_path / "good.jsonl"), "id string, n int", ("id",), closed=True).collect())) == [("a", 1), ("b", None)]
    (tmp_path / "bad.jsonl").write_text(good + bad + "\n" + bad)
    with pytest.raises(ValueError, match=r"bad\.jsonl, line 5: "):
        lines.strict(spark, str(tmp_path / "bad.jsonl"), "id string, n int", ("id",), closed=True)


def test_last_line_wins_and_the_rest_is_kept(spark, tmp_path):
    old, new = tmp_path / "in" / "z.jsonl", tmp_path / "in" / "a.jsonl"
    old.parent.mkdir()
    old.write_text('{"id": "a", "n": 1}\n{"id": "a", "n": 2}\n{"id": "b", "n": 3, "n": 9}\n{"id": "c", "n": 1, "n": 7}\nbroken\n{"id": "a", "n": "word"}\n')
    new.write_text('{"id": "b", "n": 4, "z": 1}\n{"n": 5}\n')
    import os

    os.utime(old, (1, 1))
    good, dead = lines.lenient(spark, str(old.parent), "id string, n int", "id")
    assert sorted(map(tuple, good.collect())) == [("a", 2), ("b", 4), ("c", 7)]
    assert sorted((r.file[-7:], r.line, r.reason) for r in dead.collect()) == [("a.jsonl", 2, "missing: id"), ("z.jsonl", 5, "no JSON object"), ("z.jsonl", 6, "not of the schema")]
    (tmp_path / "empty.jsonl").write_text("")
    good, dead = lines.lenient(spark, str(tmp_path / "empty.jsonl"), "id string, n int", "id")
    assert good.count() == dead.count() == 0


def test_appended(spark, tmp_path):
    path, failed = str(tmp_path / "out"), str(tmp_path / "failed")
    rows = lambda *v: spark.createDataFrame(v, "id string, n int, error string")
    lines.append_split(rows(("a", None, None), ("b", 1, "no answer")), path, failed)
    lines.append_split(rows(("a", 2, ""), ("c", 3, None)), path, failed)
    read = lambda p: sorted((json.loads(r.value) for r in spark.read.text(p).collect()), key=str)
    assert read(path) == [{"id": "a", "n": 2}, {"id": "a", "n": None}, {"id": "c", "n": 3}]
    assert [(x["id"], x["error"], bool(x["failed_at"])) for x in read(failed)] == [("b", "no answer", True)]
    assert sorted(map(tuple, lines.lenient(spark, path, "id string, n int", "id")[0].where("id = 'c'").collect())) == [("c", 3)]
