"""Chat formatting: quotation linking, in DataFrame functions alone.

A line that begins with `>` marks (spaces between them allowed) is quoted at as many levels as it has marks; neighbouring
lines of one level are a passage. A line that tells who wrote what follows ("A wrote:"), right before a deeper passage, is
an attribution and part of neither. A quoted passage is looked up by the hash of its normalised text (no marks, lower case,
single spaces) among the passages that messages of the same conversation say themselves (level 0) at an earlier turn, and
so are its paragraphs (split at blank lines) and single lines, for partial quotations; it is linked if any of these is. The
message replied to is the one from which most quoted characters of the lowest linked level come; ties go to the earliest
turn. The first message that says a passage counts as its author.

Reply order: a thread starts with a message that quotes nobody known; its replies carry the thread's root, their depth and
their position, which counts from 0 at the root and puts every message behind the one it answers and the earlier replies
to that, with all that follows from them. Ordering by conversation, root and position gives conversations without quotes.

Both sides of the join are reduced to one row per passage and conversation first, so repeated phrases cost no pairs. Depths,
sizes of subtrees and positions come by pointer doubling: as many joins as the logarithm of the longest chain of replies,
with rows of a few numbers. Replies to one message are summed up in ranges, so a message that everybody answers isn't one task's.

Defined cases: a null text counts as empty; null or empty quotes link to nothing; a null conversation or turn never
links and its message is its own root at depth 0; rows that repeat conv_id and turn are each kept, link alike and share a
position; a text of any length is parsed whole; an empty table gives no rows. Columns other than the four named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, written

MARKS = r"(?s)^(?:((?:[ \t]*>)+)[ \t]?)?(.*)$"
#: Ends of lines that name an author, in the languages of the tables.
ATTRIBUTION = r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
#: Ranges over which the replies of all conversations are dealt to be summed up.
RANGES = 64


def _normal(text):
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _parsed(messages: DataFrame) -> DataFrame:
    """Adds `passages`: array of (level, lines) in order."""
    lines = F.transform(
        F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_extract(x, MARKS, 2).alias("line")),
    )
    numbered = messages.withColumn("lines", lines)
    told = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), (x["line"].rlike(ATTRIBUTION) & (F.get("lines", i + 1)["level"] > x["level"])).alias("names")))
    # Few texts have such a line; the others are spared the look at what follows each of theirs.
    numbered = numbered.withColumn("lines", F.when(F.col("text").rlike(f"(?m){ATTRIBUTION}"), F.transform(F.filter(told, lambda x: ~F.coalesce(x["names"], F.lit(False))), lambda x: F.struct(x["level"].alias("level"), x["line"].alias("line")))).otherwise(F.col("lines")))
    begins = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == 1) | (F.get("lines", i - 1)["level"] != F.get("lines", i - 2)["level"]))
    numbered = numbered.withColumn("begins", begins)
    passages = F.transform(
        "begins",
        lambda b, k: F.struct(
            F.get("lines", b - 1)["level"].alias("level"),
            F.transform(F.slice("lines", b, F.coalesce(F.get("begins", k + 1), F.size("lines") + 1) - b), lambda x: x["line"]).alias("lines"),
        ),
    )
    return numbered.withColumn("passages", passages).drop("lines", "begins")


def _hashed(passages):
    """For each passage: its number, level and the hash and length of the whole and, if there are several, of each paragraph and line; no empty ones."""
    paragraphs = lambda p: F.transform(F.split(F.array_join(p["lines"], "\n"), r"\n\s*\n", -1), _normal)
    return F.flatten(
        F.transform(
            passages,
            lambda p, n: F.transform(
                F.filter(
                    F.array_distinct(F.concat(F.array(_normal(F.array_join(p["lines"], " "))), paragraphs(p), F.transform(p["lines"], _normal))),
                    lambda t: t != "",
                ),
                lambda t: F.struct(n.alias("passage"), p["level"].alias("level"), F.xxhash64(t).alias("hash"), F.length(t).alias("chars")),
            ),
        )
    )


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, n_quotes, max_level, n_linked, reply_to, thread_root, depth, position, text without quotes."""
    read = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    parsed = _parsed(read)
    own, quoted = F.filter("passages", lambda p: p["level"] == 0), F.filter("passages", lambda p: (p["level"] > 0) & (_normal(F.array_join(p["lines"], " ")) != ""))
    parsed = parsed.withColumn("own", own).withColumn("quoted", quoted)
    plain = F.trim(F.array_join(F.transform("own", lambda p: F.array_join(p["lines"], "\n")), "\n"), F.lit(" \t\n"))
    parsed = written(
        parsed.select("row", "conv_id", "turn", "role", plain.alias("text"), F.size("quoted").alias("n_quotes"), F.coalesce(F.array_max(F.transform("quoted", lambda p: p["level"])), F.lit(0)).alias("max_level"), _hashed(F.col("own")).alias("says"), _hashed(F.col("quoted")).alias("quotes"))
    )
    quotes = parsed.where(F.size("quotes") > 0).select("row", "conv_id", "turn", F.explode("quotes").alias("q"))
    # Only what somebody quotes is looked for: one row per conversation and passage, with its first turn.
    wanted = quotes.select("conv_id", F.col("q.hash").alias("hash")).distinct()
    says = parsed.select("conv_id", "turn", F.explode("says").alias("s")).groupBy("conv_id", F.col("s.hash").alias("hash")).agg(F.min("turn").alias("first"))
    said = wanted.join(says, ["conv_id", "hash"])
    linked = quotes.withColumn("hash", F.col("q.hash")).join(said, ["conv_id", "hash"]).where(F.col("first") < F.col("turn"))
    by_source = linked.groupBy("row", "q.level", "first").agg(F.sum("q.chars").alias("chars"), F.collect_set("q.passage").alias("passages"))
    best = by_source.groupBy("row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("passages")))).cast("long").alias("n_linked"), F.min(F.struct("level", -F.col("chars"), "first")).alias("best"))
    replies = parsed.drop("says", "quotes").join(best.select("row", "n_linked", F.col("best.first").alias("reply_to")), "row", "left")
    replies = written(replies.withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long"))))
    out = replies.join(_placed(replies.where("reply_to IS NOT NULL")), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "n_quotes", "max_level", "n_linked", "reply_to", F.coalesce("root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0).cast("long")).alias("position"), "text")


def _doubled(edges: DataFrame, values: list[str]) -> DataFrame:
    """(conv_id, turn, root, and each value summed over the way to the root) of edges (conv_id, turn, up, values): each round every message looks one jump twice as long."""
    while True:
        above = edges.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), *(F.col(v).alias(f"{v}_above") for v in values))
        sums = [(F.col(v) + F.coalesce(f"{v}_above", F.lit(0))).alias(v) for v in values]
        jumped = written(edges.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), *sums, F.col("next").isNotNull().alias("moved")))
        edges = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return edges.withColumnRenamed("up", "root")


def _sized(edges: DataFrame) -> DataFrame:
    """edges (conv_id, turn, up) with `size`, the messages of the subtree of turn: each round adds what the message that many steps below has counted so far."""
    counts = edges.select("conv_id", "turn", F.lit(1).cast("long").alias("size"))
    jumps = edges
    while True:
        more = jumps.join(counts, ["conv_id", "turn"]).groupBy("conv_id", F.col("up").alias("turn")).agg(F.sum("size").alias("more"))
        counts = written(counts.join(more, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        jumps = written(jumps.join(jumps.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next")), ["conv_id", "up"]).select("conv_id", "turn", F.col("next").alias("up")))
        if jumps.isEmpty():
            return edges.join(counts, ["conv_id", "turn"])


def _placed(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth, position) of messages that reply to one."""
    edges = written(replies.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up")))
    ranged = written(_sized(edges).repartitionByRange(RANGES, "conv_id", "up", "turn").withColumn("range", F.spark_partition_id()))
    # A reply stands behind its parent by one, and by all that earlier replies to that have below them: those of earlier ranges and those of its own.
    before = Window.partitionBy("conv_id", "up").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranged.groupBy("conv_id", "up", "range").agg(F.sum("size").alias("all")).select("conv_id", "up", "range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("conv_id", "up", "range").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(earlier, ["conv_id", "up", "range"])
    steps = written(offsets.select("conv_id", "turn", "up", F.lit(1).alias("depth"), (1 + F.col("inside") + F.col("earlier")).alias("position")))
    return _doubled(steps, ["depth", "position"])


def as_mail(messages: DataFrame) -> DataFrame:
    """messages in which replies quote earlier turns of their conversation as mail programs do, by fixed arithmetic on conv_id and turn.

    Of five messages one quotes the turn before under a line that names its author; one also the turn before that, a level
    deeper; one only the first line; one the turn before in other spacing, below its own text; the last one nothing.
    """
    said = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.min("role").alias("role"))
    kind_of = lambda turn: F.pmod(7 * F.col("conv_id") + 3 * turn, F.lit(5))
    # Only what a later turn quotes goes there.
    later = said.withColumn("turn", F.col("turn") + 1).withColumn("kind", kind_of(F.col("turn"))).where("kind > 0")
    one = later.select("conv_id", "turn", F.when(F.col("kind") == 3, F.substring_index("text", "\n", 1)).otherwise(F.col("text")).alias("text1"), F.when(F.col("kind") == 1, F.col("role")).alias("role1"))
    two = said.withColumn("turn", F.col("turn") + 2).where(kind_of(F.col("turn")) == 2).select("conv_id", "turn", F.col("text").alias("text2"))
    met = messages.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    quoted = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))
    text, one, two = F.coalesce("text", F.lit("")), F.col("text1"), F.col("text2")
    kind = kind_of(F.col("turn"))
    mail = F.when(one.isNull(), text)
    mail = mail.when(kind == 1, F.concat(F.coalesce("role1", F.lit("somebody")), F.lit(" wrote:\n"), quoted(one, "> "), text))
    mail = mail.when(kind == 2, F.concat(F.coalesce(quoted(two, "> > "), F.lit("")), quoted(one, "> "), text))
    mail = mail.when(kind == 3, F.concat(quoted(one, "> "), text))
    mail = mail.when(kind == 4, F.concat(text, F.lit("\n"), quoted(F.replace(one, F.lit(" "), F.lit("  ")), ">")))
    return met.select("conv_id", "turn", "role", mail.otherwise(text).alias("text"))


def op3(spark, sf_dir: str) -> DataFrame:
    """All of `conversations`, quoting each other as as_mail() makes them: the table itself has no quoted line."""
    return link_quotations(as_mail(table(spark, sf_dir, "conversations")))


_NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
SQL = rf"""
WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS text, min(role) AS role FROM conversations GROUP BY ALL),
met AS (SELECT row_number() OVER () AS row, m.conv_id, m.turn, m.role, coalesce(m.text, '') AS own, a.text AS one, a.role AS who, b.text AS two, (7 * m.conv_id + 3 * m.turn) % 5 AS kind
  FROM conversations m LEFT JOIN said a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 LEFT JOIN said b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2),
mail AS (SELECT *, CASE WHEN one IS NULL THEN own
  WHEN kind = 1 THEN coalesce(who, 'somebody') || ' wrote:' || chr(10) || '> ' || replace(one, chr(10), chr(10) || '> ') || chr(10) || own
  WHEN kind = 2 THEN coalesce('> > ' || replace(two, chr(10), chr(10) || '> > ') || chr(10), '') || '> ' || replace(one, chr(10), chr(10) || '> ') || chr(10) || own
  WHEN kind = 3 THEN '> ' || string_split(one, chr(10))[1] || chr(10) || own
  WHEN kind = 4 THEN own || chr(10) || '>' || replace(replace(one, ' ', '  '), chr(10), chr(10) || '>') || chr(10)
  ELSE own END AS text FROM met),
raw AS (SELECT row, conv_id, turn, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT *, string_split(text, chr(10)) AS l FROM mail)),
read AS (SELECT row, conv_id, turn, i, len(replace(replace(regexp_extract(x, '^((?:[ 	]*>)*)', 1), ' ', ''), chr(9), '')) AS level, regexp_extract(x, '^(?:[ 	]*>)*[ 	]?(.*)$', 1) AS line FROM raw),
lines AS (SELECT * FROM read QUALIFY NOT coalesce(lead(level) OVER (PARTITION BY row ORDER BY i) > level AND regexp_matches(line, 'wrote\s*:\s*$'), false)),
marked AS (SELECT *, coalesce(level <> lag(level) OVER w, true) AS starts, trim(line, ' ' || chr(9)) = '' AS blank FROM lines WINDOW w AS (PARTITION BY row ORDER BY i)),
runs AS (SELECT *, sum(starts::INT) OVER w AS b, sum((starts OR blank)::INT) OVER w AS g FROM marked WINDOW w AS (PARTITION BY row ORDER BY i)),
parts AS (SELECT DISTINCT row, conv_id, turn, level, b, t FROM (
  SELECT row, conv_id, turn, level, b, {_NORMAL.format("string_agg(line, ' ' ORDER BY i)")} AS t FROM runs GROUP BY ALL
  UNION ALL SELECT row, conv_id, turn, level, b, t FROM (SELECT row, conv_id, turn, level, b, g, {_NORMAL.format("string_agg(line, ' ' ORDER BY i)")} AS t FROM runs GROUP BY ALL)
  UNION ALL SELECT row, conv_id, turn, level, b, {_NORMAL.format("line")} FROM runs) WHERE t <> ''),
says AS (SELECT conv_id, t, min(turn) AS first FROM parts WHERE level = 0 GROUP BY ALL),
links AS (SELECT p.row, p.level, p.b, s.first, len(p.t) AS chars FROM parts p JOIN says s ON p.conv_id = s.conv_id AND p.t = s.t AND s.first < p.turn WHERE p.level > 0),
best AS (SELECT row, first AS reply_to FROM (SELECT row, level, first, sum(chars) AS chars FROM links GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row ORDER BY level, chars DESC, first) = 1),
told AS (SELECT m.row, m.conv_id, m.turn, m.role, m.own, q.n_quotes, q.max_level, coalesce(k.n_linked, 0) AS n_linked, r.reply_to FROM mail m LEFT JOIN best r ON r.row = m.row
  LEFT JOIN (SELECT row, count(DISTINCT b) AS n_linked FROM links GROUP BY ALL) k ON k.row = m.row
  LEFT JOIN (SELECT row, count(DISTINCT CASE WHEN level > 0 THEN b END) AS n_quotes, max(CASE WHEN level > 0 THEN level ELSE 0 END) AS max_level FROM (SELECT row, level, b FROM parts) GROUP BY ALL) q ON q.row = m.row),
node AS (SELECT conv_id, turn, min(reply_to) AS up FROM told GROUP BY ALL),
tree AS (SELECT conv_id, turn, turn AS root, 0 AS depth, [turn] AS path FROM node WHERE up IS NULL
  UNION ALL SELECT n.conv_id, n.turn, t.root, t.depth + 1, list_append(t.path, n.turn) FROM node n JOIN tree t ON n.conv_id = t.conv_id AND n.up = t.turn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, root ORDER BY path) - 1 AS position FROM tree)
SELECT t.conv_id, t.turn, t.role, CAST(coalesce(t.n_quotes, 0) AS INT) AS n_quotes, CAST(coalesce(t.max_level, 0) AS INT) AS max_level, t.n_linked, t.reply_to, p.root AS thread_root, p.depth, p.position, trim(t.own, ' ' || chr(9) || chr(10)) AS text
FROM told t JOIN placed p ON p.conv_id = t.conv_id AND p.turn = t.turn"""
