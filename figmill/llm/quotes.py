"""Chat formatting by quotation linking.

Messages quote others as mail does, in lines that begin with `>`, one for each level.  The quoted
passages are normalised and hashed, and joined to the message that says them first-hand; that is
the message replied to.  What comes out are conversations in reply order, without the quotes.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figmill.operators.series import numbered

from .blocks import checkpointed

MARK = re.compile(r"^((?:[ \t]*>)+) ?")
INTRO = re.compile(r"^[^\n]*\b(?:wrote|said|schrieb|écrit|escribió)\s*:\s*$", re.I)
PART = 1000


def passages(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(the text without quotes, [(level, passage)]): level 0 is the writer's own words; blank lines and changes of level part passages."""
    own: list[str] = []
    found: list[tuple[int, str]] = []
    now: list[str] = []
    level = 0

    def end():
        t = " ".join(" ".join(now).split()).casefold()
        if t:
            found.append((level, t))
        now.clear()

    lines = text.split("\n")
    marks = [MARK.match(line) for line in lines]
    for n, (line, m) in enumerate(zip(lines, marks, strict=True)):
        depth = m.group(1).count(">") if m else 0
        body = line[m.end() :] if m else line
        if depth != level or not body.strip():
            end()
            level = depth
        if not m and INTRO.match(line) and n + 1 < len(lines) and marks[n + 1]:
            continue
        now.append(body)
        if not m:
            own.append(line)
    end()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if any(marks) else text, found


def digest(passage: str) -> int:
    return xxhash.xxh64_intdigest(passage.encode("utf-8", "surrogatepass")) - (1 << 63)


PARSED = "conv_id long, turn long, role string, text string, n_quotes int, own array<long>, quoted array<struct<level:int,hash:long>>"


def parse(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each message without quotes, with the hashes of its own passages (and of itself whole) and of those it quotes."""

    def run(parts):
        for batch in parts:
            texts, n, own, quoted = [], [], [], []
            for t in batch.column(3).to_pylist():
                clean, found = passages(t or "")
                mine = [p for level, p in found if not level]
                texts.append(clean)
                n.append(sum(level > 0 for level, _ in found))
                own.append(sorted({digest(p) for p in [*mine, " ".join(mine)] if p}))
                quoted.append([{"level": level, "hash": digest(p)} for level, p in found if level])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(quoted, pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())])))], [x.split()[0] for x in PARSED.split(", ")[:7]])

    return df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PARSED)


FIRST = -(1 << 63)  # stands for a null turn, which comes first
SPAN = 4096


def _before(turns: DataFrame) -> DataFrame:
    """(conv_id, t, before): the turn before each distinct turn of a conversation; no window is longer than SPAN turns."""
    d = turns.withColumn("span", F.floor(F.col("t") / SPAN))
    last = d.groupBy("conv_id", "span").agg(F.max("t").alias("last"))
    last = last.select("conv_id", "span", F.lag("last").over(Window.partitionBy("conv_id").orderBy("span")).alias("earlier"))
    own = d.withColumn("own", F.lag("t").over(Window.partitionBy("conv_id", "span").orderBy("t")))
    at = own.conv_id.eqNullSafe(last.conv_id) & (own.span == last.span)
    return own.join(last, at).select(own.conv_id, "t", F.coalesce("own", "earlier").alias("before"))


def reply_order(turns: DataFrame) -> DataFrame:
    """(conv_id, t, place) of turns (conv_id, t, parent): depth first, a turn before its replies, replies by turn.

    The tour of each tree, down into a turn and up out of it, is a linked list; a place is the number of turns entered
    from there to the end, which pointer doubling adds up in a number of rounds that is the logarithm of the
    longest conversation's length.  No conversation is gathered in one task.
    """
    key = ["conv", "t"]
    d = turns.select(F.struct("conv_id").alias("conv"), "t", "parent")  # a struct is never null, so null conversations join
    kids = d.select("conv", F.col("parent").alias("p"), "t")
    w = Window.partitionBy("conv", "p").orderBy("t")
    nxt = kids.select("conv", "t", F.lead("t").over(w).alias("sibling"))
    first = kids.filter("p is not null").groupBy("conv", F.col("p").alias("t")).agg(F.min("t").alias("child"))
    n = d.join(nxt, key).join(first, key, "left")
    down = n.select("conv", F.struct("t", F.lit(False).alias("up")).alias("at"), F.when(F.col("child").isNotNull(), F.struct(F.col("child").alias("t"), F.lit(False).alias("up"))).otherwise(F.struct("t", F.lit(True).alias("up"))).alias("to"), F.lit(1).cast("long").alias("n"))
    up = n.select("conv", F.struct("t", F.lit(True).alias("up")).alias("at"), F.when(F.col("sibling").isNotNull(), F.struct(F.col("sibling").alias("t"), F.lit(False).alias("up"))).when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("t"), F.lit(True).alias("up"))).alias("to"), F.lit(0).cast("long").alias("n"))
    tour = checkpointed(down.unionByName(up))
    while tour.filter("to is not null").head(1):
        ahead = tour.select("conv", F.col("at").alias("to"), F.col("to").alias("then"), F.col("n").alias("more"))
        tour = checkpointed(tour.join(ahead, ["conv", "to"], "left").select("conv", "at", F.col("then").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    return tour.filter("not at.up").select("conv.conv_id", "at.t", (-F.col("n")).alias("place"))


def link(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_conv, parent_turn, position.

    n_linked counts the quoted passages that some earlier message of the conversation, or else any message of
    another one, says first-hand.  The parent is where the shallowest linked quote comes from (the latest such
    turn in the conversation; the smallest (conversation, turn) elsewhere), or else the turn before.  position
    counts a conversation's messages from 0 in reply order: depth first, a turn before its replies, replies by
    turn; rows of one turn stay together, in the order of role and text, and have the parent of the first of them in that order that has
    one in the conversation.  Null texts are empty; rows with a null conversation form one conversation; a null
    turn comes first.  Repeated rows stay.  Nothing is collected by conversation or passage.
    """
    m = parse(df, conv_col, turn_col, role_col, text_col).withColumn("key", F.xxhash64("role", "text"))
    m = checkpointed(m.withColumn("t", F.coalesce("turn", F.lit(FIRST))))
    own = m.select("conv_id", "t", F.explode("own").alias("hash")).distinct()
    quoted = m.select("conv_id", "t", F.inline("quoted"), "key").select("conv_id", "t", "hash", F.lit(False).alias("own"), "level", "key").distinct()
    said = own.join(quoted.select("hash").distinct(), "hash", "left_semi").select("conv_id", "t", "hash", F.lit(True).alias("own"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("key"))
    w = Window.partitionBy("conv_id", "hash").orderBy("t", "own").rowsBetween(Window.unboundedPreceding, 0)
    near = said.unionByName(quoted).withColumn("from", F.max(F.when(F.col("own"), F.col("t"))).over(w)).filter(~F.col("own"))
    # The first speakers of the two smallest conversations: one of them isn't the quoting one.
    speaker = said.groupBy("hash", "conv_id").agg(F.min("t").alias("t"))
    one = speaker.groupBy("hash").agg(F.min(F.struct("conv_id", "t")).alias("one"))
    two = speaker.join(one, "hash").filter(~F.col("conv_id").eqNullSafe(F.col("one.conv_id"))).groupBy("hash").agg(F.min(F.struct("conv_id", "t")).alias("two"))
    j = near.join(one, "hash", "left").join(two, "hash", "left")
    other = F.when(F.col("one").isNotNull() & ~F.col("one.conv_id").eqNullSafe(F.col("conv_id")), F.col("one")).otherwise(F.col("two"))
    found = j.select("conv_id", "t", "key", "level", "hash", F.when(F.col("from").isNotNull(), F.struct(F.col("conv_id"), F.col("from").alias("t"))).otherwise(other).alias("source"), F.col("from").isNull().alias("away"))
    best = found.filter("source is not null").groupBy("conv_id", "t", "key").agg(F.count(F.lit(1)).cast("int").alias("n_linked"), F.min(F.struct("level", "away", F.when(~F.col("away"), F.bitwise_not("source.t")).alias("late"), "source")).alias("b"))
    best = best.select(F.col("conv_id").alias("c"), F.col("t").alias("t1"), F.col("key").alias("k"), "n_linked", "b.source")
    before = _before(m.select("conv_id", "t").distinct()).select(F.col("conv_id").alias("c2"), F.col("t").alias("t2"), "before")
    out = m.join(best, m.conv_id.eqNullSafe(F.col("c")) & (m.t == F.col("t1")) & (m.key == F.col("k")), "left")
    out = out.join(before, out.conv_id.eqNullSafe(F.col("c2")) & (out.t == F.col("t2")), "left").drop("c", "t1", "k", "c2", "t2")
    here = F.col("source").isNotNull() & F.col("source.conv_id").eqNullSafe(F.col("conv_id")) & (F.col("source.t") < F.col("t"))
    out = checkpointed(out.withColumn("inner", F.when(here, F.col("source.t"))))
    # Conversations in which some turn answers another one than the turn before are put in reply order; the others are in it.
    tree = out.groupBy("conv_id", "t").agg(F.min_by("inner", F.when(F.col("inner").isNotNull(), F.struct("role", "text"))).alias("inner"), F.first("before").alias("before"))
    tree = tree.select("conv_id", "t", F.coalesce("inner", "before").alias("parent"), "before")
    turned = tree.filter(~F.col("parent").eqNullSafe(F.col("before"))).select(F.col("conv_id").alias("c")).distinct()
    branchy = tree.join(turned, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "t", "parent")
    if branchy.head(1):
        place = reply_order(branchy).select(F.col("conv_id").alias("c"), F.col("t").alias("t1"), "place")
        out = out.join(place, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("t") == F.col("t1")), "left").withColumn("order_", F.coalesce("place", "t"))
    else:
        out = out.withColumn("order_", F.col("t"))
    out = numbered(out.withColumn("conv_", F.struct("conv_id")), ["conv_"], ["order_", "role", "text"], F.floor(F.col("order_") / SPAN))
    shown = lambda c: F.when(c != FIRST, c)
    far = F.col("source").isNotNull()
    parent = F.when(far, F.col("source.conv_id")).when(F.col("before").isNotNull(), F.col("conv_id"))
    return out.select("conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), parent.alias("parent_conv"), shown(F.when(far, F.col("source.t")).otherwise(F.col("before"))).alias("parent_turn"), F.col("n_").cast("long").alias("position"))


def conversations(messages: DataFrame, part: int = PART) -> DataFrame:
    """link()'s rows as conversations: conv_id, part, messages (in reply order); `part` messages a row, so a conversation of any length fits."""
    m = messages.withColumn("part", F.floor(F.col("position") / part))
    return m.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("position", "turn", "role", "text", "n_quotes", "n_linked", "parent_conv", "parent_turn"))).alias("messages"))
