"""Chat formatting by quotation linking.

Messages quote earlier ones in lines that begin with '>' marks. Nested levels
are parsed, each quoted passage is normalised and hashed, the hash is joined to
original messages and their passages, and conversations come out in reply order
without the quotes. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.rows import spread_join
from lodestack.plans.storage import Scratch

#: '>' marks with blanks between them, at a line's start.
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: Shorter passages are too common to name a message of another conversation.
FAR_CHARS = 12
#: The parent of a conversation's threads, below any turn.
_TOP = -(1 << 62)


def normalised(text: Column) -> Column:
    """Lower case with every run of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, quotes, depth): each message without its
    quoted lines, its quoted passages (level, text) and the deepest level.

    A passage is a run of neighbouring lines of one level, the number of '>'
    marks a line begins with. A null text is an empty message.
    """
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", ""))
    rows = messages.withColumn("_raw", F.split(F.coalesce("text", F.lit("")), "\r?\n"))
    # Most messages quote nothing: their lines are not looked at one by one.
    quoting = F.coalesce(F.contains("text", F.lit(">")), F.lit(False))
    rows = rows.withColumn("_lv", F.when(quoting, F.transform("_raw", level)).otherwise(F.array_repeat(F.lit(0), F.size("_raw"))))
    rows = rows.withColumn("_tx", F.when(quoting, F.transform("_raw", lambda x: F.regexp_replace(x, _MARKS, ""))).otherwise(F.col("_raw")))
    starts = F.filter(F.sequence(F.lit(0), F.size("_lv") - 1), lambda i: (i == 0) | (F.get(F.col("_lv"), i) != F.get(F.col("_lv"), F.greatest(i - 1, F.lit(0)))))
    rows = rows.withColumn("_st", F.when(quoting, starts).otherwise(F.array(F.lit(0))))
    passage = lambda s, k: F.struct(F.get(F.col("_lv"), s).alias("level"), F.array_join(F.slice("_tx", s + 1, F.coalesce(F.get(F.col("_st"), k + 1), F.size("_tx")) - s), "\n").alias("text"))
    rows = rows.withColumn("_runs", F.transform("_st", passage))
    quotes = F.filter("_runs", lambda x: (x["level"] > 0) & (F.trim(x["text"]) != ""))
    own = F.trim(F.array_join(F.transform(F.filter("_runs", lambda x: x["level"] == 0), lambda x: x["text"]), "\n"), F.lit(" \t\r\n"))
    return rows.select("conv_id", "turn", "role", own.alias("own"), quotes.alias("quotes"), F.coalesce(F.array_max("_lv"), F.lit(0)).alias("depth"))


def passages(parsed: DataFrame) -> DataFrame:
    """(key, conv_id, turn): hashes of what a message itself says, as a whole
    and by paragraph and line, each once."""
    own = F.col("own")
    parts = F.concat(F.array(own), F.split(own, r"\n[ \t]*\n"), F.split(own, "\n"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(parts, normalised), lambda x: x != ""), lambda x: F.md5(x)))
    return parsed.select(F.explode(keys).alias("key"), "conv_id", "turn")


class Blocks:
    """Rows sorted by ``keys`` and ``order`` and cut into blocks of like size.

    A running value over one key's rows is taken inside each block, and from
    block to block over one row each, so a key that holds a third of all rows
    is never sorted or walked through in one task.
    """

    def __init__(self, rows: DataFrame, scratch: Scratch, keys: list[str], order: list[str]):
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        self.keys, self.order = keys, order
        self.rows = scratch.table(rows.repartitionByRange(parts, *keys, *order).withColumn("_b", F.spark_partition_id()), "blocks")
        self.inside = Window.partitionBy(*keys, "_b").orderBy(*order)
        self.across = Window.partitionBy(*keys).orderBy("_b")

    def _carried(self, value: Column, over: Callable, name: str) -> DataFrame:
        """``rows`` with what ``over`` gives of each block's ``value``."""
        blocks = self.rows.groupBy(*self.keys, "_b").agg(value.alias("_v"))
        return self.rows.join(blocks.withColumn(name, over(F.col("_v"))).drop("_v"), [*self.keys, "_b"])

    def number(self, name: str) -> "Blocks":
        """Each row's place among its key's rows, from 0."""
        carried = self._carried(F.count("*"), lambda v: F.sum(v).over(self.across.rowsBetween(Window.unboundedPreceding, -1)), "_c")
        return self._with(carried.withColumn(name, F.row_number().over(self.inside) - 1 + F.coalesce("_c", F.lit(0))))

    def largest(self, value: Column, name: str, earlier: bool = False) -> "Blocks":
        """The largest ``value`` up to each row, or among rows before its place."""
        carried = self._carried(F.max(value), lambda v: F.max(v).over(self.across.rowsBetween(Window.unboundedPreceding, -1)), "_c")
        frame = self.inside.rangeBetween(Window.unboundedPreceding, -1) if earlier else self.inside.rowsBetween(Window.unboundedPreceding, 0)
        return self._with(carried.withColumn(name, F.greatest(F.max(value).over(frame), F.col("_c"))))

    def neighbour(self, value: Column, name: str, after: bool = False) -> "Blocks":
        """``value`` of the row before, or after, each row."""
        edge = (F.min_by if after else F.max_by)(value, F.struct(*self.order))
        step = F.lead if after else F.lag
        carried = self._carried(edge, lambda v: step(v).over(self.across), "_c")
        return self._with(carried.withColumn(name, F.coalesce(step(value).over(self.inside), F.col("_c"))))

    def _with(self, rows: DataFrame) -> "Blocks":
        other = object.__new__(Blocks)
        other.__dict__ = {**self.__dict__, "rows": rows.drop("_c")}
        return other


def link_quotes(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, to_conv, to_turn, n_linked): the message that a message
    answers, and how many of its quotes are found.

    A quoted passage names the message that says it, as a whole or, if nothing
    does, by a line: the latest earlier message of its own conversation, else
    the first of all conversations if that comes before; the latter only for
    passages of FAR_CHARS or more. Of a message's quotes the shallowest found
    one counts, then the last in the text.

    Only hashes that some quote asks for are joined, dealt to several parts,
    and every hash is reduced to one row over all conversations first; inside a
    conversation a running maximum finds the latest message. So a phrase that a
    third of all messages say makes no pairs and fills no task.
    """
    quotes = parsed.filter(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("place", "q"))
    parts = F.concat(F.array(F.struct(F.lit(0).alias("grain"), F.col("q.text").alias("text"))), F.transform(F.split("q.text", "\n"), lambda x: F.struct(F.lit(1).alias("grain"), x.alias("text"))))
    asked = quotes.select("conv_id", "turn", "place", F.col("q.level").alias("level"), F.explode(parts).alias("p")).select("conv_id", "turn", "place", "level", "p.grain", normalised(F.col("p.text")).alias("n"))
    asked = scratch.table(asked.filter("n <> ''").select("conv_id", "turn", "place", "level", "grain", F.md5("n").alias("key"), (F.length("n") >= FAR_CHARS).alias("far")), "asked")
    said = spread_join(passages(parsed), asked.select("key").distinct(), ["key"], F.col("turn"), "left_semi")
    first = said.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    none = F.lit(None).cast("int")
    both = asked.withColumn("said", F.lit(None).cast("long")).unionByName(said.select("key", "conv_id", "turn", F.col("turn").alias("said"), none.alias("place"), none.alias("level"), none.alias("grain"), F.lit(False).alias("far")))
    here = Blocks(both, scratch, ["key", "conv_id"], ["turn"]).largest(F.col("said"), "here", earlier=True).rows.filter("said is null")
    found = spread_join(here, first, ["key"], F.struct("conv_id", "turn"), "left")
    place = lambda c, t: F.struct(c.alias("conv_id"), t.alias("turn"))
    elsewhere = F.when(F.col("far") & ((F.col("first.conv_id") < F.col("conv_id")) | ((F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.turn") < F.col("turn")))), place(F.col("first.conv_id"), F.col("first.turn")))
    found = found.withColumn("to", F.coalesce(F.when(F.col("here").isNotNull(), place(F.col("conv_id"), F.col("here"))), elsewhere)).filter("to is not null")
    best = found.groupBy("conv_id", "turn").agg(F.min_by("to", F.struct(F.col("level"), F.col("grain"), -F.col("place"), F.col("to"))).alias("to"), F.countDistinct("place").alias("n_linked"))
    return best.select("conv_id", "turn", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn"), "n_linked")


def reply_order(messages: DataFrame, scratch: Scratch, most_rounds: int = 64) -> DataFrame:
    """``messages`` (conv_id, turn, parent_conv, parent_turn and others) with
    ``thread`` and ``position``: the turn of the message that a message's
    replies go back to, and its place in its conversation when every message is
    followed by its replies, each with all of theirs, in order of turn.

    A parent must come before its message; one in another conversation makes
    the message the beginning of a thread. Messages that answer the one before
    them form runs. Runs are a tree; a walk around it that enters and leaves
    each run once is a linked list, and its places follow from pointer doubling:
    as many rounds as the longest list has binary digits, each one a join of
    unique keys. Conversations of one run need none.
    """
    ordered = Blocks(messages, scratch, ["conv_id"], ["turn"]).neighbour(F.col("turn"), "_before").number("_index")
    inside = F.col("parent_conv").eqNullSafe(F.col("conv_id")) & F.col("parent_turn").isNotNull()
    rows = ordered.rows.withColumn("_up", F.when(inside, F.col("parent_turn")))
    ordered.rows = rows.withColumn("_begins", F.col("_before").isNull() | ~F.col("_up").eqNullSafe(F.col("_before")))
    rows = scratch.table(ordered.largest(F.when(F.col("_begins"), F.col("turn")), "_run").rows.drop("_b", "_before"), "ordered")

    many = rows.filter("_begins").groupBy("conv_id").agg(F.count("*").alias("_k")).filter("_k > 1").select("conv_id")
    # Few columns of the conversations that hold more than one run.
    slim = scratch.table(spread_join(rows.select("conv_id", "turn", "_up", "_index", "_begins", "_run"), many, ["conv_id"], F.col("turn"), "left_semi"), "slim")
    runs = slim.groupBy("conv_id", "_run").agg(F.count("*").alias("size"), F.min("_index").alias("start"), F.max(F.when(F.col("_begins"), F.col("_up"))).alias("up"))
    ups = runs.filter("up is not null").select("conv_id", F.col("up").alias("turn")).distinct()
    at = slim.join(ups, ["conv_id", "turn"], "left_semi").select("conv_id", F.col("turn").alias("up"), F.col("_run").alias("parent"), (-F.col("_index")).alias("back"))
    # Replies to a run's later messages come first, and before the message's own.
    tree = spread_join(runs, at, ["conv_id", "up"], F.col("_run"), "left").withColumns({"parent": F.coalesce("parent", F.lit(_TOP)), "back": F.coalesce("back", F.lit(0))})
    family = Blocks(tree, scratch, ["conv_id", "parent"], ["back", "_run"]).neighbour(F.col("_run"), "older").neighbour(F.col("_run"), "younger", after=True)
    family = scratch.table(family.rows.select("conv_id", "_run", "size", "start", "parent", "older", "younger"), "family")

    firsts = family.filter(f"older is null and parent <> {_TOP}").select(F.col("conv_id").alias("_c"), F.col("parent").alias("_p"), F.col("_run").alias("child"))
    nodes = family.join(firsts, (F.col("conv_id") == F.col("_c")) & (F.col("_run") == F.col("_p")), "left")
    step = lambda turn, leaves, weight, to, to_leaves: F.struct(turn.alias("t"), F.lit(leaves).alias("leaves"), weight.cast("long").alias("w"), to.alias("to"), to_leaves.alias("to_leaves"))
    enter = step(F.col("_run"), False, F.col("size"), F.coalesce("child", "_run"), F.col("child").isNull())
    up = F.when(F.col("parent") != _TOP, F.col("parent"))
    leave = step(F.col("_run"), True, F.lit(0), F.coalesce("younger", up), F.col("younger").isNull())
    walk = scratch.table(nodes.select("conv_id", F.explode(F.array(enter, leave)).alias("x")).select("conv_id", "x.*"), "walk")
    for _ in range(most_rounds):
        if walk.filter("to is not null").isEmpty():
            break
        ahead = walk.select(F.col("conv_id").alias("_c"), F.col("t").alias("_t"), F.col("leaves").alias("_l"), F.col("w").alias("_w"), F.col("to").alias("_to"), F.col("to_leaves").alias("_tl"))
        both = walk.join(ahead, (F.col("conv_id") == F.col("_c")) & (F.col("to") == F.col("_t")) & (F.col("to_leaves") == F.col("_l")), "left")
        after = scratch.table(both.select("conv_id", "t", "leaves", (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.col("_to").alias("to"), F.col("_tl").alias("to_leaves")), "walk")
        scratch.drop(walk)
        walk = after
    else:
        raise RuntimeError(f"replies did not settle in {most_rounds} rounds")

    left = walk.filter("not leaves").select("conv_id", F.col("t").alias("_run"), "w")
    whole = left.groupBy("conv_id").agg(F.max("w").alias("all"))
    placed = family.join(left, ["conv_id", "_run"])
    placed = spread_join(placed, whole, ["conv_id"], F.col("_run")).select("conv_id", "_run", "start", (F.col("all") - F.col("w")).alias("_at"), (F.col("parent") == _TOP).alias("top"))
    found = Blocks(placed, scratch, ["conv_id"], ["_at"]).largest(F.when(F.col("top"), F.struct("_at", "_run")), "root").rows
    found = found.select(F.col("conv_id").alias("_c"), F.col("_run").alias("_r"), (F.col("_at") - F.col("start")).alias("shift"), F.col("root._run").alias("root"))
    # A run may hold a third of all messages, as may a conversation of one run.
    out = spread_join(rows.withColumns({"_c": F.col("conv_id"), "_r": F.col("_run")}), found, ["_c", "_r"], F.col("turn"), "left")
    return out.select(*[c for c in messages.columns], F.coalesce("root", "_run").alias("thread"), (F.col("_index") + F.coalesce("shift", F.lit(0))).alias("position"))


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, quote_depth, parent_conv,
    parent_turn, thread, position) of every message of ``messages`` (conv_id,
    turn, role, text).

    ``text`` has no quotes. The parent is the message a quote names, else the
    message before it in its conversation, else null. ``thread`` is the turn of
    the message that a message's replies go back to inside its conversation;
    ordered by (conv_id, position), every message stands after what it answers,
    followed by its replies, each with all of theirs.
    Rows of equal conv_id and turn are one message, that with the smallest role
    and text; rows with a null conv_id or turn are messages without links, and
    their position is null. An empty table gives an empty result; other columns
    are not read.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    ids = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    whole = messages.select(*ids, "role", "text")
    one = whole.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    parsed = scratch.table(parse(one), "parsed")
    links = link_quotes(parsed, scratch).withColumnsRenamed({"conv_id": "_c", "turn": "_t"})
    linked = parsed.select("conv_id", "turn").join(links, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")
    before = Blocks(linked, scratch, ["conv_id"], ["turn"]).neighbour(F.col("turn"), "before").rows
    parents = before.select("conv_id", "turn", F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"), F.when(F.col("to_turn").isNotNull(), F.col("to_conv")).when(F.col("before").isNotNull(), F.col("conv_id")).alias("parent_conv"), F.coalesce("to_turn", "before").alias("parent_turn"))
    rows = parsed.join(reply_order(parents, scratch), ["conv_id", "turn"])
    columns = ["conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").alias("n_quotes"), "n_linked", F.col("depth").alias("quote_depth"), "parent_conv", "parent_turn", "thread", "position"]
    none = F.lit(None).cast("long")
    loose = parse(whole.filter("conv_id is null or turn is null")).withColumns({"n_linked": F.lit(0), "parent_conv": none, "parent_turn": none, "thread": F.col("turn"), "position": none})
    return rows.select(*columns).unionAll(loose.select(*columns))


def render(formatted: DataFrame) -> DataFrame:
    """(conv_id, chat): each conversation as one text in reply order, with the
    role before each message. One conversation is one row by nature; use the
    rows of format_chats where one may not fit."""
    line = F.struct("position", F.concat_ws("\n", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>")), F.col("text")).alias("m"))
    return formatted.filter("position is not null").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["m"]), "\n").alias("chat"))


def query(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
lv AS (SELECT conv_id, turn, k, length(regexp_replace(regexp_extract(raw, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(raw, '^[ \t]*((?:>[ \t]?)+)', '') AS t
       FROM (SELECT conv_id, turn, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS raw FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS l FROM m))),
rn AS (SELECT *, sum(b) OVER (PARTITION BY conv_id, turn ORDER BY k) AS run
       FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv_id, turn ORDER BY k) THEN 1 ELSE 0 END AS b FROM lv)),
runs AS (SELECT conv_id, turn, run, min(level) AS level, string_agg(t, chr(10) ORDER BY k) AS t FROM rn GROUP BY conv_id, turn, run),
own AS (SELECT conv_id, turn, trim(coalesce(string_agg(t, chr(10) ORDER BY run) FILTER (level = 0), ''), chr(32) || chr(9) || chr(13) || chr(10)) AS own,
               count(*) FILTER (level > 0 AND trim(t) <> '') AS n_quotes, max(level) AS depth FROM runs GROUP BY conv_id, turn),
quotes AS (SELECT conv_id, turn, run AS place, level, t FROM runs WHERE level > 0 AND trim(t) <> ''),
asked AS (SELECT *, length(n) >= 12 AS far FROM (SELECT conv_id, turn, place, level, grain, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) AS n
          FROM (SELECT conv_id, turn, place, level, 0 AS grain, t AS p FROM quotes UNION ALL SELECT conv_id, turn, place, level, 1, unnest(string_split(t, chr(10))) FROM quotes)) WHERE n <> ''),
said AS (SELECT DISTINCT conv_id, turn, n FROM (SELECT conv_id, turn, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) AS n
         FROM (SELECT conv_id, turn, own AS p FROM own UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(own, '\n[ \t]*\n')) FROM own
               UNION ALL SELECT conv_id, turn, unnest(string_split(own, chr(10))) FROM own)) WHERE n IN (SELECT n FROM asked)),
here AS (SELECT a.conv_id, a.turn, a.place, a.level, a.grain, a.n, a.far, max(s.turn) AS here FROM asked a LEFT JOIN said s ON s.n = a.n AND s.conv_id = a.conv_id AND s.turn < a.turn GROUP BY ALL),
first AS (SELECT n, min({'c': conv_id, 't': turn}) AS f FROM said GROUP BY n),
found AS (SELECT conv_id, turn, place, level, grain, CASE WHEN here IS NOT NULL THEN {'c': conv_id, 't': here} WHEN far AND (f.c < conv_id OR (f.c = conv_id AND f.t < turn)) THEN f END AS goal FROM here LEFT JOIN first USING (n)),
best AS (SELECT conv_id, turn, arg_min(goal, {'a': level, 'b': grain, 'c': -place, 'd': goal.c, 'e': goal.t}) AS goal, count(DISTINCT place) AS n_linked FROM found WHERE goal IS NOT NULL GROUP BY conv_id, turn),
r AS (SELECT m.conv_id, m.turn, role, own, n_quotes, depth, n_linked, goal, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn) AS before
      FROM m JOIN own USING (conv_id, turn) LEFT JOIN best USING (conv_id, turn)),
p AS (SELECT *, CASE WHEN goal IS NOT NULL THEN goal.c WHEN before IS NOT NULL THEN conv_id END AS parent_conv, coalesce(goal.t, before) AS parent_turn FROM r),
tree AS (SELECT conv_id, turn, [turn] AS path FROM p WHERE parent_conv IS DISTINCT FROM conv_id
         UNION ALL SELECT p.conv_id, p.turn, list_append(tree.path, p.turn) FROM tree JOIN p ON p.conv_id = tree.conv_id AND p.parent_conv = tree.conv_id AND p.parent_turn = tree.turn)
SELECT conv_id, turn, role, own AS text, CAST(n_quotes AS INTEGER) AS n_quotes, CAST(coalesce(n_linked, 0) AS INTEGER) AS n_linked, CAST(depth AS INTEGER) AS quote_depth, parent_conv, parent_turn,
       path[1] AS thread, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS position
FROM p JOIN tree USING (conv_id, turn)
"""

#: Messages that quote: two of four the message two turns before, one the first of the conversation before.
_REPLIES = """SELECT a.conv_id, a.turn, a.role, CASE WHEN b.text IS NULL THEN a.text ELSE concat('> ', replace(b.text, chr(10), concat(chr(10), '> ')), chr(10), a.text) END AS text
FROM {table} a LEFT JOIN {table} b ON (a.turn % 4 >= 2 AND b.conv_id = a.conv_id AND b.turn = a.turn - 2) OR (a.turn % 4 = 0 AND b.conv_id = a.conv_id - 1 AND b.turn = 0)"""


def replies_query(spark, sf_dir: str) -> DataFrame:
    """The same over conversations in which messages quote others."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    a, b = table.alias("a"), table.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text").alias("quoted"))
    asked = a.withColumns({"c": F.when(F.col("turn") % 4 >= 2, F.col("conv_id")).when(F.col("turn") % 4 == 0, F.col("conv_id") - 1), "t": F.when(F.col("turn") % 4 >= 2, F.col("turn") - 2).when(F.col("turn") % 4 == 0, F.lit(0))})
    quote = F.concat(F.lit("> "), F.replace("quoted", F.lit("\n"), F.lit("\n> ")), F.lit("\n"), F.col("text"))
    return format_chats(asked.join(b, ["c", "t"], "left").select("conv_id", "turn", "role", F.when(F.col("quoted").isNull(), F.col("text")).otherwise(quote).alias("text")))


REPLIES_SQL = SQL.replace("FROM conversations)", "FROM (" + _REPLIES.format(table="conversations") + "))")
