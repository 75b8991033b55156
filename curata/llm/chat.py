"""Quotation linking of chat and mail messages.

A line that starts with `>` marks quotes others; the number of marks is its level. Adjacent quoted lines of one level are a
passage. Passages are normalised and hashed (SHA-256) and joined with the messages of the same conversation that say the
same lines in a row without marks, whatever the level; where no message says a whole passage, its lines are looked up one
by one. A message answers the latest earlier message that it quotes most lines of at its lowest level with a link, as a
rule level one. The answers give each message a depth, a thread and a position in its conversation, by which it is read in
the order of its replies, without the quotes.

A stretch of 2^k lines is hashed from its two halves, so all stretches of a message take a hash each and level. A passage
of n lines is known by its first and its last 2^k lines, the largest power that n holds, and is found by the first: what a
message says meets only passages that it shares at least half with, however common their first lines are.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.llm.kernels import tidy
from curata.llm.scratch import Scratch

_MARKS = r"^(?:[ \t]*>)+"
_INTRO = r"(?i)^\s*(.*\bwrote:|-{2,}\s*original message\s*-{2,})\s*$"
#: Turns of a block: the latest earlier source of a quote is looked for in the quote's own block, and else in the blocks before.
BLOCK = 1024
_LEVEL, _BREAK, _BLANK = re.compile(r"(?:[ \t]*>)+"), re.compile(r"\r\n?|\n"), re.compile(r"[\x00-\x20]+")
#: Reply chains double their reach each round, so this is beyond any chain of 2**40 messages.
MAX_ROUNDS = 40


def level(line: Column) -> Column:
    """The number of quote marks that a line starts with."""
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.length(F.regexp_replace(marks, r"[^>]", ""))


def passages(text: str) -> tuple[list[tuple[int, list[str]]], list[str]]:
    """(level, line digests) of each quoted passage, and the digests of the lines without marks. Lines without words are skipped."""
    quoted: list[tuple[int, list[str]]] = []
    own: list[str] = []
    last = 0
    for line in _BREAK.split(text):
        marks = _LEVEL.match(line)
        level = marks[0].count(">") if marks else 0
        said = _BLANK.sub(" ", line[marks.end() if marks else 0 :].lower()).strip(" ")
        if not said:
            continue
        digest = hashlib.sha256(said.encode("utf-8", "replace")).hexdigest()[:32]
        if not level:
            own.append(digest)
        elif level == last:
            quoted[-1][1].append(digest)
        else:
            quoted.append((level, [digest]))
        last = level
    return quoted, own


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _folded(lines: list[str]) -> str:
    """The hash of 2^k lines: that of the hashes of the two halves. One line is its own."""
    while len(lines) > 1:
        lines = [_digest(lines[i] + lines[i + 1]) for i in range(0, len(lines), 2)]
    return lines[0]


def passage_keys(lines: list[str]) -> tuple[str, str]:
    """(head, key): the hash of the first 2^k lines, k as large as can be, and that of the passage."""
    n = len(lines)
    most = 1 << n.bit_length() - 1
    head = _folded(lines[:most])
    return head, head if n == most else _digest(f"{head}{_folded(lines[n - most:])}{n}")


def stretches(lines: Column, most: Column, levels: int) -> list[Column]:
    """The hashes of all stretches of 2^k lines for each k below levels; none where k is above most."""

    def doubled(last: Column, k: int) -> Column:
        count = F.when(most >= k, F.greatest(F.size(lines) - (1 << k) + 1, F.lit(0))).otherwise(0)
        return F.transform(F.slice(last, 1, count), lambda x, i: F.substring(F.sha2(F.concat(x, F.get(last, i + (1 << k - 1))), 256), 1, 32))

    out = [lines]
    for k in range(1, levels):
        out.append(doubled(out[-1], k))
    return out


def _parse(batches):
    for batch in batches:
        rows = []
        for i, text in enumerate(batch.column(2).to_pylist()):
            if text:
                quoted, own = passages(text)
                rows += [(i, level, lines, *passage_keys(lines)) for level, lines in quoted]
                if own:
                    rows.append((i, 0, own, *passage_keys(own)))
        at = pa.array([r[0] for r in rows], pa.int64())
        told = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()), 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *told], ["conv_id", "turn", "level", "lines", "head", "key"])


def said_passages(own: DataFrame, wanted: DataFrame, levels: int) -> DataFrame:
    """(conv_id, turn, key) of the stretches of own (conv_id, turn, lines, row) that share the head of a passage of wanted (conv_id, head, n).

    levels is one more than the largest k. A conversation's stretches are looked up at the lengths that its passages
    have. Places are gathered per message and made into keys next to its hashes, so lines are not repeated for each hit.
    """
    lengths = wanted.select("conv_id", (F.length(F.bin("n")) - 1).alias("k")).groupBy("conv_id").agg(F.collect_set("k").alias("ks"))
    rows = own.dropDuplicates(["conv_id", "turn", "row"]).join(lengths, "conv_id").withColumn("most", F.array_max("ks"))
    rows = rows.withColumn("win", F.array(*stretches(F.col("lines"), F.col("most"), levels)))
    places = F.flatten(F.transform("ks", lambda k: F.transform(F.get("win", k), lambda x, i: F.struct(x.alias("head"), i.alias("pos")))))
    said = rows.select("conv_id", "turn", "row", F.size("lines").alias("size"), F.inline(places))
    hits = said.join(wanted, ["conv_id", "head"]).filter("pos + n <= size")
    runs = hits.groupBy("conv_id", "turn", "row").agg(F.collect_set(F.struct("pos", "n")).alias("at"))

    def key(a: Column) -> Column:
        k = F.length(F.bin(a["n"])) - 1
        most = F.call_function("shiftleft", F.lit(1), k)
        head, tail = F.get(F.get("win", k), a["pos"]), F.get(F.get("win", k), a["pos"] + a["n"] - most)
        return F.when(a["n"] == most, head).otherwise(F.substring(F.sha2(F.concat(head, tail, a["n"].cast("string")), 256), 1, 32))

    return rows.join(runs, ["conv_id", "turn", "row"]).select("conv_id", "turn", F.explode(F.array_distinct(F.transform("at", key))).alias("key"))


def reply_positions(placed: DataFrame, work: Scratch) -> DataFrame:
    """placed (conv_id, turn, thread_turn, reply_depth, parent_turn) with position: from 0 in each conversation, by thread, depth, the answered turn and turn.

    Rows are sorted by range and counted for each range, so no conversation is numbered in one task.
    """
    order = ["conv_id", "thread_turn", "reply_depth", "parent_turn", "turn"]
    spread = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    numbered = work.table(spread, "numbered")
    sums = numbered.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    before = sums.select("conv_id", "part", "first", F.coalesce(F.sum("c").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(before, ["conv_id", "part"]).select(*placed.columns, (F.col("before") + F.col("at") - F.col("first")).alias("position"))


def reply_ordered(linked: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, reply, reply_depth) of `link_quotes`: the conversations without quotes, each in the order of its replies.

    Every message follows the one it answers. Messages without a conversation or turn have no position and are left out.
    """
    return linked.filter("position is not null").select("conv_id", "position", "turn", "role", "reply", "reply_depth").orderBy("conv_id", "position")


def latest_before(sources: DataFrame, quotes: DataFrame) -> DataFrame:
    """The rows of quotes (conv_id, key, turn, ...) with parent, the latest earlier turn of sources (conv_id, key, turn), if there is one.

    Turns are cut into blocks, so a passage that a whole conversation repeats is never ordered in one task: a task gets
    the turns of a block, and a row for each block that says the passage.
    """
    names = quotes.columns
    block = F.floor(F.col("turn") / BLOCK)
    said = sources.select("conv_id", "key", "turn").distinct().withColumn("from", F.col("turn"))
    both = said.unionByName(quotes.withColumn("from", F.lit(None).cast("bigint")), allowMissingColumns=True).withColumn("block", block)
    near = W.partitionBy("conv_id", "key", "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    inside = both.withColumn("near", F.last("from", ignorenulls=True).over(near)).filter("`from` is null")
    blocks = both.groupBy("conv_id", "key", "block").agg(F.max("from").alias("top"))
    before = W.partitionBy("conv_id", "key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    far = blocks.select("conv_id", "key", "block", F.last("top", ignorenulls=True).over(before).alias("far")).filter("far is not null")
    out = inside.join(far, ["conv_id", "key", "block"], "left")
    return out.select(*names, F.coalesce("near", "far").alias("parent")).filter("parent is not null")


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n", -1)


def reply_text(text: Column) -> Column:
    """The lines without quotes and without the lines that introduce them, with outer white space cut."""
    lines = lines_of(text)
    quoted = F.exists(lines, lambda x: x.rlike(_MARKS))
    own = F.filter(lines, lambda x: ~x.rlike(_MARKS) & ~(quoted & x.rlike(_INTRO)))
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, reply, quote_depth, quoted_lines, linked_lines, parent_turn, reply_depth, thread_turn, parent_level, position.

    quote_depth is the deepest level of a quoted line. linked_lines counts the lines of all levels that an earlier turn
    says: those of whole passages, each passage once at its lowest level, and of the other passages the lines that some
    turn says, each once. parent_turn is the earlier turn of the conversation that most linked lines of level one come from
    (the latest of those with as many; each passage or line counts for the latest earlier turn that says it); where nothing of level one is
    found the next level with a link decides; or null. parent_level is the level that decided. reply_depth counts the
    answers above a message and thread_turn is the topmost message, itself if it answers none. position numbers the turns
    of a conversation from 0 by (thread_turn, reply_depth, parent_turn, turn), so that every message follows the one it
    answers; `reply_ordered` gives the conversations in that order. Null texts are empty; messages with a null conversation
    or turn are kept, link with nothing and have no position; repeated rows of one turn are linked alike and share a
    position; an empty table gives an empty result; other columns are ignored.

    A message is looked at where it says the first 2^k lines of a passage that its conversation quotes (k as large as can
    be). Quotes and sources of a passage never meet in pairs.
    """
    work = Scratch(messages.sparkSession, "chat")
    base = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    levels = F.transform(lines_of(F.col("text")), level)
    told = base.select("conv_id", "turn", "role", reply_text(F.col("text")).alias("reply"), F.coalesce(F.array_max(levels), F.lit(0)).alias("quote_depth"), F.size(F.filter(levels, lambda x: x > 0)).alias("quoted_lines"))
    kind = base.schema["conv_id"].dataType.simpleString()
    spoken = base.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "text")
    units = work.table(spoken.mapInArrow(tidy(_parse), f"conv_id {kind}, turn bigint, level int, lines array<string>, head string, key string"), "units")
    quoted = units.filter("level > 0").groupBy("conv_id", "turn", "key", "head", "lines").agg(F.min("level").alias("level"))
    each = quoted.select("conv_id", "turn", F.col("key").alias("of"), "level", F.explode("lines").alias("key"))
    wanted = work.table(quoted.select("conv_id", "head", F.size("lines").alias("n")).union(each.select("conv_id", "key", F.lit(1))).distinct(), "wanted")
    longest = wanted.agg(F.max("n")).first()[0] or 1
    own = units.filter("level = 0").select("conv_id", "turn", "lines", F.col("key").alias("row"))
    sources = said_passages(own, wanted, longest.bit_length())
    whole = quoted.select("conv_id", "turn", "key", "level", F.size("lines").alias("n"), F.lit(True).alias("whole"))
    single = each.groupBy("conv_id", "turn", "key").agg(F.min("level").alias("level")).select("conv_id", "turn", "key", "level", F.lit(1).alias("n"), F.lit(False).alias("whole"))
    found = work.table(latest_before(sources, whole.unionByName(single)), "found")
    linked = found.filter("whole")
    told_whole = each.join(linked.select("conv_id", "turn", F.col("key").alias("of")), ["conv_id", "turn", "of"], "left_semi").select("conv_id", "turn", "key").distinct()
    votes = linked.unionByName(found.filter("not whole").join(told_whole, ["conv_id", "turn", "key"], "left_anti"))
    votes = votes.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("n").alias("count"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max_by("parent", F.struct(-F.col("level"), "count", "parent")).alias("parent_turn"), F.min("level").alias("parent_level"), F.sum("count").alias("linked_lines"))
    parents = work.table(parents, "parents")
    # pointer doubling: each round a message's highest known ancestor is replaced by that one's own
    up = work.table(parents.select("conv_id", "turn", F.col("parent_turn").alias("top"), F.lit(1).cast("bigint").alias("depth")), "up0")
    for k in range(1, MAX_ROUNDS):
        above = up.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        step = up.join(above, ["conv_id", "top"], "left")
        if step.filter("next is not null").limit(1).count() == 0:
            break
        up = work.table(step.select("conv_id", "turn", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), f"up{k}")
        work.drop(f"up{k - 1}")
    else:
        raise RuntimeError("the reply chains don't end")
    linked = parents.join(up, ["conv_id", "turn"])
    ids = spoken.select("conv_id", "turn").distinct().join(linked, ["conv_id", "turn"], "left")
    placed = ids.select("conv_id", "turn", F.coalesce("top", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("reply_depth"), "parent_turn", "parent_level", "linked_lines")
    out = told.join(reply_positions(placed, work), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "reply", F.col("quote_depth").cast("int").alias("quote_depth"), F.col("quoted_lines").cast("bigint").alias("quoted_lines"), F.coalesce("linked_lines", F.lit(0)).cast("bigint").alias("linked_lines"), "parent_turn", F.coalesce("reply_depth", F.lit(0)).cast("bigint").alias("reply_depth"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.col("parent_level").cast("int").alias("parent_level"), "position")
