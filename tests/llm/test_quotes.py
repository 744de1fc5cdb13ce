import random

import duckdb
from pyspark.sql import functions as F

from siftstone.llm import quotes


def test_thread(spark):
    rows = [
        (1, 0, "user", "Where is the key?\nI lost it."),
        (1, 1, "bot", "> Where is  the KEY?\nUnder the mat."),
        (1, 2, "user", "> > Where is the key?\n> Under the mat.\nThanks!"),
        (1, 3, "bot", "> never said by anyone\nHm."),
        (2, 0, "user", "> Under the mat.\nAnother thread."),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row", F.lit(1))).collect()}
    assert [(got[1, t].reply_to, got[1, t].thread_root, got[1, t].depth) for t in range(4)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0)]
    assert got[1, 2].max_level == 2 and got[1, 2].text == "Thanks!" and got[2, 0].reply_to is None
    assert got[1, 1].n_linked == 1 and got[1, 2].n_linked == 2 and got[1, 3].n_quotes == 1


def test_query_has_every_message_and_no_python(spark):
    df = quotes.op3(spark, "/root/testdata/sf0.001")
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count()
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, reply_to long"
    rows = [(1, 0, "u", None, 1), (1, 1, "u", "", 1), (1, 2, None, ">\n>>  \n", 1), (None, 0, "u", "hello there", 1), (None, 1, "u", "> hello there", 1), (1, None, "u", "> x", 1), (1, 3, "u", "x", 1), (1, 3, "u", "x", 1), (1, 4, "u", "> x\n" + "word " * 20000, 1)]
    got = quotes.link_quotations(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    assert [r.reply_to for r in got if r.turn == 4] == [3] and all(r.reply_to is None for r in got if r.conv_id is None or r.turn is None)
    assert quotes.link_quotations(spark.createDataFrame([], schema)).count() == 0


def test_paragraphs_lines_and_paths(spark):
    rows = [
        (1, 0, "user", "Para one line1\nline2\n\nPara two\nhas more\nand ends"),
        (1, 1, "bot", "> Para one line1 line2\nYes."),
        (1, 2, "bot", "> Para two\n> has more\nNo."),
        (1, 3, "user", "> Yes.\nSure?"),
        (1, 4, "bot", "> nobody said so\n>\n> Sure?\nIt is."),
        (1, 5, "user", "Something else."),
    ]
    df = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.turn: r for r in df.collect()}
    assert [got[t].reply_to for t in range(6)] == [None, 0, 0, 1, 3, None]
    assert [got[t].n_linked for t in range(6)] == [0, 1, 1, 1, 1, 0]
    assert [(got[t].thread_root, got[t].position) for t in range(6)] == [(0, 0), (0, 1), (0, 4), (0, 2), (0, 3), (5, 0)]
    assert [r.turn for r in df.orderBy("conv_id", "thread_root", "position").collect()] == [0, 1, 3, 4, 2, 5]


def test_attributions_go_and_other_lines_stay(spark):
    rows = [
        (1, 0, "user", "  indented\nHe wrote:\nnothing at all\u2028still this line"),
        (1, 1, "bot", "Ann wrote:\n> indented\n> He wrote:\nFine."),
        (1, 2, "bot", "> Bob schrieb:\n> > nothing at all\u2028still this line\n> Fine.\nOh."),
    ]
    got = {r.turn: r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t].text for t in range(3)] == ["indented\nHe wrote:\nnothing at all\u2028still this line", "Fine.", "Oh."]
    assert [(got[t].n_quotes, got[t].n_linked, got[t].reply_to) for t in range(3)] == [(0, 0, None), (1, 1, 0), (2, 2, 1)]


def test_positions_against_a_walk(spark, monkeypatch):
    rng = random.Random(3)
    up = {(c, t): rng.choice([None, 0, t - 1, rng.randrange(t)]) if t else None for c in range(6) for t in range(70)}
    rows = [(c, t, "u", f"say {c} {t}." + ("" if u is None else f"\n> say {c} {u}.")) for (c, t), u in up.items()]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}

    def walk(c, t, root, depth, at):
        r = got[c, t]
        # A message's own line follows its author's, so replies name whom they quote.
        assert (r.thread_root, r.depth, r.position) == (root, depth, at[0])
        at[0] += 1
        for below in sorted(x for (d, x), u in up.items() if d == c and u == t):
            walk(c, below, root, depth + 1, at)

    for (c, t), u in up.items():
        if u is None:
            walk(c, t, t, 0, [0])


def test_query_links_what_it_quotes(spark):
    rows = quotes.op3(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_linked for r in rows) > 20 and max(r.depth for r in rows) > 1 and max(r.max_level for r in rows) == 2
    said = {(r.conv_id, r.turn): (r.text or "").strip(" \t\n") for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}
    assert all(r.text == said[r.conv_id, r.turn] for r in rows)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want, got = con.sql(quotes.SQL), quotes.op3(spark, "/root/testdata/sf0.01")
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
