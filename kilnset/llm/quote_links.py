"""Chat formatting: quotation linking with DataFrame functions only.

A line whose first marks are ``>`` (blanks between and before them allowed) is
quoted, as deep as it has marks. Neighbouring lines of one depth are a passage.
Quoted passages and what messages say themselves (the whole of it, each passage,
each run of neighbouring lines, blank ones left out) are normalised - lower case,
white space runs as one blank, ends trimmed - and hashed. Runs of several lines are
looked at only where one begins like a quoted passage of as many lines; sums over line
hashes, as differences of running sums, tell which are like it, and one run of each
message is compared in full. A quote links to the earliest message of its conversation
that says the same, if that has a smaller turn. A message replies to the latest
turn that its shallowest linked quotes come from. Messages are listed thread by
thread: below the message they reply to, otherwise by turn.

Only messages with quotes are taken apart, and only conversations with quotes are
indexed. Places in a thread are numbers, not paths: sizes of subtrees, and the rows
before each message, are summed by doubling of the reply links, so a chain of n
replies costs log n rounds over n numbers. Positions in a conversation, below a
message and in a turn come from ranges of the order, so a huge one is spread over many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnset.llm.scratch import Scratch
from kilnset.operators.ranking import positions, running

QUOTED = r"(?m)^[ \t]*>"
#: Sums of line hashes (40 bits) times squared places.
SUM = "decimal(38,0)"
MARKS = r"^[ \t]*(?:>[ \t]*)+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


def _passages(messages: DataFrame) -> DataFrame:
    """mid, talk, turn, run, depth, body: passages of each message."""
    lines = messages.select("mid", "talk", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    mark = F.regexp_extract("line", MARKS, 0)
    lines = lines.withColumn("depth", F.length(F.regexp_replace(mark, "[^>]", "")))
    lines = lines.withColumn("body", F.expr("substring(line, length(regexp_extract(line, '%s', 0)) + 1)" % MARKS.replace("\\", "\\\\")))
    within = Window.partitionBy("mid").orderBy("at")  # one message
    change = F.when(F.lag("depth").over(within) == F.col("depth"), 0).otherwise(1)
    lines = lines.withColumn("change", change)
    lines = lines.withColumn("run", F.sum("change").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n")
    return lines.groupBy("mid", "talk", "turn", "run", "depth").agg(body.alias("body"))


def _said_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def _sums(line: Column, place: Column) -> list[Column]:
    """What a line adds to the three sums of a run that has it at ``place``."""
    number = F.conv(F.substring(F.md5(line), 1, 10), 16, 10).cast(SUM)
    return [number, (number * place).cast(SUM), (number * place * place).cast(SUM)]


def _line_runs(whole: DataFrame, quotes: DataFrame, scratch: Scratch) -> DataFrame:
    """talk, turn, key: passages of two and more lines quoted in the conversation
    that ``whole`` (mid, talk, turn, own) has as a run of lines."""
    heads = quotes.select("talk", "key", _said_lines(F.col("body")).alias("said")).where(F.size("said") > 1)
    heads = heads.dropDuplicates(["talk", "key"]).withColumn("n", F.size("said"))
    cells = heads.select("talk", "key", "n", F.md5(F.get("said", F.lit(0))).alias("head"), F.posexplode("said").alias("at", "line"))
    wanted = scratch.write(cells.groupBy("talk", "key", "n", "head").agg(
        *[F.sum(x).cast(SUM).alias(f"q{k}") for k, x in enumerate(_sums(F.col("line"), F.col("at")))]))
    talks = wanted.select("talk").distinct()
    told = whole.join(talks, "talk", "left_semi").select("mid", "talk", "turn", _said_lines(F.col("own")).alias("said"))
    told = scratch.write(told.where(F.size("said") > 1))
    lines = told.select("mid", "talk", F.size("said").alias("of"), F.posexplode("said").alias("at", "line"))
    upto = Window.partitionBy("mid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # one message
    parts = _sums(F.col("line"), F.col("at"))
    lines = scratch.write(lines.select(
        "mid", "talk", "of", "at", F.md5("line").alias("head"),
        *[F.sum(x).over(upto).cast(SUM).alias(f"s{k}") for k, x in enumerate(parts)],
        *[x.alias(f"x{k}") for k, x in enumerate(parts)]))
    # a start is met by each number of lines that a passage with its line has, not by each passage
    sizes = wanted.select("talk", "head", "n").distinct()
    begins = lines.join(sizes, ["talk", "head"]).where(F.col("at") + F.col("n") <= F.col("of")).select(
        "mid", "talk", "head", "n", "at", (F.col("at") + F.col("n") - 1).alias("last"),
        *[(F.col(f"s{k}") - F.col(f"x{k}")).cast(SUM).alias(f"b{k}") for k in range(3)])
    ends = lines.select("mid", F.col("at").alias("last"), *[F.col(f"s{k}").alias(f"e{k}") for k in range(3)])
    d0, d1, d2 = (F.col(f"e{k}") - F.col(f"b{k}") for k in range(3))
    at = F.col("at")
    runs = begins.join(ends, ["mid", "last"]).select(
        "mid", "talk", "head", "n", "at", d0.cast(SUM).alias("q0"), (d1 - at * d0).cast(SUM).alias("q1"),
        (d2 - 2 * at * d1 + at * at * d0).cast(SUM).alias("q2"))
    alike = runs.join(wanted, ["talk", "head", "n", "q0", "q1", "q2"]).groupBy("mid", "key", "n").agg(F.min("at").alias("at"))
    full = alike.join(told, "mid").withColumn("unit", F.array_join(F.slice("said", F.col("at") + 1, F.col("n")), " "))
    return full.where(F.md5("unit") == F.col("key")).select("talk", "turn", "key")


def _threads(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """talk, turn, node, first, depth: where the rows of each turn begin in their
    conversation, thread by thread. ``rows`` has talk, turn, reply_to, copies."""
    turns = rows.groupBy("talk", "turn").agg(F.max("reply_to").alias("up_turn"), F.sum("copies").alias("own"))
    nodes = scratch.write(turns.withColumn("node", F.monotonically_increasing_id()))
    above = nodes.select("talk", F.col("turn").alias("up_turn"), F.col("node").alias("up"), F.col("own").alias("own_up"))
    edges = scratch.write(nodes.where("up_turn is not null").join(above, ["talk", "up_turn"]).select("node", "up", "own_up"))

    # rows below each message, from links of twice the reach each round
    size, jump = scratch.write(nodes.select("node", F.col("own").alias("size"))), edges.select("node", "up")
    while not jump.isEmpty():
        gained = jump.join(size, "node").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        size = scratch.write(size.join(gained, "node", "left").select(
            "node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        further = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jump = scratch.write(jump.join(further, "up").select("node", F.col("next").alias("up")))

    # rows before a message: earlier ones below the same message, and that one's own
    placed = scratch.write(nodes.join(size, "node").join(edges, "node", "left").select(
        "node", "talk", "turn", "up", "own_up", "size"))
    before = running(placed, {"upto": ("sum", F.col("size"))}, ["turn", "node"], ["talk", "up"])
    state = scratch.write(before.select(
        "node", "talk", "turn", "up", (F.col("upto") - F.col("size") + F.coalesce("own_up", F.lit(0))).alias("first"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while not state.where("up is not null").isEmpty():
        far = state.select(F.col("node").alias("up"), F.col("first").alias("f"), F.col("depth").alias("d"), F.col("up").alias("next"))
        state = scratch.write(state.join(far, "up", "left").select(
            "node", "talk", "turn", F.col("next").alias("up"), (F.col("first") + F.coalesce("f", F.lit(0))).alias("first"),
            (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")))
    return state.select("talk", "turn", "node", "first", "depth")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per input row of ``(conv_id, turn, role, text)``: conv_id,
    position (from 0 in reply order), turn, role, reply_to (a turn), depth (0 for
    the start of a thread), n_quotes, n_linked, text (without quotes).

    Null texts are empty; rows with a null conv_id are a conversation of their own;
    null turns come first, quote nothing and are not quoted; rows alike in all columns
    follow each other; an empty table gives an empty one; other columns are not looked
    at.
    """
    scratch = Scratch(messages.sparkSession, "quote-links")
    base = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    # joins pass over nulls, so a conversation is named by a text; a message by a number
    base = base.withColumn("talk", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    base = scratch.write(base.withColumn("mid", F.monotonically_increasing_id()))
    quoting = base.where(F.col("text").rlike(QUOTED))
    parts = scratch.write(_passages(quoting.select("mid", "talk", "turn", "text")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "body"))), lambda x: x["body"]), "\n")
    said = parts.where("depth = 0").groupBy("mid").agg(body.alias("own"))
    clean = base.join(said, "mid", "left").withColumn("own", F.when(
        F.col("text").rlike(QUOTED), F.coalesce("own", F.lit(""))).otherwise(F.col("text")))
    clean = scratch.write(clean)

    quotes = parts.where("depth > 0").withColumn("key", F.md5(normalised(F.col("body"))))
    talks = quoting.select("talk").distinct()
    whole = clean.join(talks, "talk", "left_semi").where("turn is not null")
    units = whole.select("talk", "turn", F.explode(F.concat(F.array("own"), F.split("own", "\n"))).alias("unit"))
    runs = parts.where("depth = 0 and turn is not null").select("talk", "turn", F.col("body").alias("unit"))
    units = units.unionByName(runs).withColumn("unit", normalised(F.col("unit"))).where("unit <> ''")
    keys = units.select("talk", "turn", F.md5("unit").alias("key")).unionByName(_line_runs(whole, quotes, scratch))
    source = keys.groupBy("talk", "key").agg(F.min("turn").alias("said_at"))
    linked = quotes.join(source, ["talk", "key"], "left").withColumn(
        "said_at", F.when(F.col("said_at") < F.col("turn"), F.col("said_at")))
    per = linked.groupBy("mid").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("said_at").alias("n_linked"),
        F.max(F.when(F.col("said_at").isNotNull(), F.struct((-F.col("depth")).alias("d"), "said_at")))["said_at"].alias("reply_to"))
    rows = scratch.write(clean.join(per, "mid", "left").select(
        "conv_id", "talk", "turn", "role", F.col("own").alias("text"), F.md5("own").alias("mark"), "copies",
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to"))

    threads = _threads(rows, scratch).withColumnsRenamed({"talk": "its_talk", "turn": "its_turn"})
    same = (F.col("talk") == F.col("its_talk")) & F.col("turn").eqNullSafe(F.col("its_turn"))
    out = rows.join(threads, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    placed = positions(scratch.write(out.drop("its_talk", "its_turn", "talk", "copies")),
                       ["role", "mark", "reply_to", "n_quotes", "copy"], ["node"], name="place")
    return placed.select("conv_id", (F.col("first") + F.col("place")).alias("position"), "turn", "role", "reply_to", "depth",
                         F.col("n_quotes").cast("long"), F.col("n_linked").cast("long"), "text")
