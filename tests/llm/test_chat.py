import re

from pyspark.sql import functions as F

from lodestack.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "Hello there, how do I sort a list in Python?"),
    (1, 1, "assistant", "Use the sorted() builtin.\n\nIt returns a new list always."),
    (1, 2, "user", "> Use the sorted() builtin.\n\nAnd in place?"),
    (1, 3, "user", "> > Hello there, how do I sort a list in Python?\n> It returns a new list always.\nok"),
    (1, 4, "user", ">hello THERE,  how do I sort a list in python?\nBetter question"),
    (2, 0, "user", None),
    (2, 1, "user", "> Better question asked\n"),
    (2, 2, "x", "> It returns a new list always.\n> Some other line of text here\n cool"),
    (3, 0, "u", ""),
    (3, 0, "u", ""),
    (4, 5, "u", "first of a late start"),
    (4, 9, "u", "5 > 3 is no quote"),
    (None, 1, "user", "> abc\nq"),
]


def brute(rows):
    """The same in plain Python: (conv, turn) -> (text, parent, thread, position)."""
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    messages = {}
    for c, t, r, x in rows:
        if c is not None and t is not None:
            messages[c, t] = x or ""
    own, quotes = {}, {}
    for key, text in messages.items():
        runs = []
        for line in text.split("\n"):
            marks = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
            level, rest = (marks[1].count(">"), line[marks.end() :]) if marks else (0, line)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(rest)
            else:
                runs.append((level, [rest]))
        own[key] = "\n".join("\n".join(p) for n, p in runs if n == 0).strip(" \t\r\n")
        quotes[key] = [(n, "\n".join(p)) for n, p in runs if n and "\n".join(p).strip(" ")]
    said = {}
    for key, text in own.items():
        for part in {norm(p) for p in [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]} - {""}:
            said.setdefault(part, set()).add(key)
    parents = {}
    for c, t in sorted(messages):
        best = []
        for place, (level, text) in enumerate(quotes[c, t]):
            for grain, part in [(0, text), *((1, x) for x in text.split("\n"))]:
                found = said.get(norm(part), set())
                here = [k for k in found if k[0] == c and k[1] < t]
                if here:
                    best.append(((level, grain, -place, max(here)), max(here)))
                elif found and min(found) < (c, t) and len(norm(part)) >= chat.FAR_CHARS:
                    best.append(((level, grain, -place, min(found)), min(found)))
        before = max((k for k in messages if k[0] == c and k[1] < t), default=None)
        parents[c, t] = min(best)[1] if best else before
    return {k: (own[k], parents[k], *place) for k, place in walked(parents).items()}


def walked(parents):
    """(conv, turn) -> (thread, position), by walking down the replies."""
    children, out, at = {}, {}, {}
    for k in sorted(parents):
        up = parents[k]
        children.setdefault(up if up and up[0] == k[0] else ("top", k[0]), []).append(k)
    for c in {k[0] for k in parents}:
        stack = [(k, k[1]) for k in reversed(children.get(("top", c), []))]
        while stack:
            k, thread = stack.pop()
            out[k] = (thread, at.get(c, 0))
            at[c] = at.get(c, 0) + 1
            stack += [(x, thread) for x in reversed(children.get(k, []))]
    return out


def _parent(r):
    return None if r.parent_turn is None else (r.parent_conv, r.parent_turn)


def test_quotes_link_as_by_hand(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("own", F.lit("clash")).withColumn("thread", F.lit(1))
    got = chat.format_chats(docs).collect()
    assert {(r.conv_id, r.turn): (r.text, _parent(r), r.thread, r.position) for r in got if r.conv_id is not None} == brute(ROWS)
    assert len(got) == len(ROWS) - 1  # the repeated message is one
    loose = next(r for r in got if r.conv_id is None)
    assert (loose.text, loose.n_quotes, loose.n_linked, loose.parent_turn, loose.position) == ("q", 1, 0, None, None)
    two = next(r for r in got if (r.conv_id, r.turn) == (1, 3))
    assert (two.n_quotes, two.n_linked, two.quote_depth) == (2, 2, 2)


def test_replies_stand_behind_what_they_answer(spark):
    rows = [(1, 0, "u", "the very first message"), (1, 1, "v", "a second remark about it"), (1, 2, "u", "> the very first message\nto the first"), (1, 3, "v", "> a second remark about it\nto the second"), (1, 4, "u", "goes on")]
    got = sorted((r.position, r.turn, r.thread, _parent(r)) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, 0, None), (1, 1, 0, (1, 0)), (2, 3, 0, (1, 1)), (3, 4, 0, (1, 3)), (4, 2, 0, (1, 0))]
    text = chat.render(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).first().chat
    assert text.index("to the second") < text.index("goes on") < text.index("to the first")


def test_short_quotes_link_inside_a_conversation(spark):
    rows = [(1, 0, "u", "ok, at 5pm"), (1, 1, "v", "fine"), (1, 2, "u", "> ok, at 5pm\nbetter at six"), (2, 0, "u", "> ok, at 5pm\nwhat?")]
    got = {(r.conv_id, r.turn): _parent(r) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0): None, (1, 1): (1, 0), (1, 2): (1, 0), (2, 0): None}


def test_made_up_threads_against_brute_force(spark):
    import random

    rng = random.Random(4)
    rows, texts = [], []
    for c in range(12):
        for t in range(rng.choice([1, 2, 5, 9, 60])):
            body = f"message number {c} {t} says something\nand a second line {rng.randrange(4)} of it"
            if texts and rng.random() < 0.6:
                quoted = rng.choice(texts[-40:]).split("\n")
                body = "\n".join(">" * rng.randint(1, 3) + " " + q for q in quoted[: rng.randint(1, len(quoted))]) + "\n" + body
            rows.append((c, t * 3, "user", body))
            texts.append(re.sub(r"(?m)^>.*\n", "", body))
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.conv_id, r.turn): (r.text, _parent(r), r.thread, r.position) for r in got} == brute(rows)


def test_reply_order_of_one_large_conversation(spark):
    """A conversation that all parts share, with one message that many answer."""
    import random

    from lodestack.plans.storage import Scratch

    rng = random.Random(8)
    parents = {(7, t): None if t == 0 or rng.random() < 0.01 else (7, rng.choice([0, t - 1, t - 1, rng.randrange(t)])) if rng.random() < 0.9 else (6, 0) for t in range(3000)}
    rows = [(c, t, *(p or (None, None)), "x") for (c, t), p in parents.items()]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, parent_conv long, parent_turn long, role string")
    got = chat.reply_order(docs, Scratch(spark, "chat")).collect()
    assert {(r.conv_id, r.turn): (r.thread, r.position) for r in got} == walked(parents)


def test_render_table_and_limits(spark, small):
    out = chat.query(spark, small)
    assert out.count() == spark.read.parquet(f"{small}/conversations.parquet").count()
    assert not re.search("Python|Pandas|ArrowEval", out._jdf.queryExecution().toString())
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_chats(empty).count() == 0
    long = spark.createDataFrame([(1, 0, "u", "> q\nline\n" * 8000)], SCHEMA)
    assert chat.format_chats(long).first().n_quotes == 8000
    text = chat.render(chat.format_chats(spark.createDataFrame(ROWS[:3], SCHEMA))).first().chat
    assert text.startswith("<|user|>\nHello there") and text.endswith("And in place?")


def test_matches_sql(spark, small, same):
    assert same(chat.query(spark, small), chat.SQL) == 87


def test_derived_replies_match_sql(spark, small, same):
    out = chat.replies_query(spark, small)
    assert same(out, chat.REPLIES_SQL) == 87
    rows = out.collect()
    assert sum(r.n_linked for r in rows) > 10 and any(r.position != r.turn for r in rows)


def test_matches_sql_with_quotes(spark):
    import duckdb
    import pandas as pd

    rows = sorted({r for r in ROWS if r[0] is not None}, key=str)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    rel = con.execute(chat.SQL)
    order = [[d[0] for d in rel.description].index(c) for c in got.columns]
    want = sorted(str([r[i] for i in order]) for r in rel.fetchall())
    assert sorted(str(list(r)) for r in got.collect()) == want
