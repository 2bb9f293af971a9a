"""Conversations from quotations: who answered whom, by what was quoted; DataFrame functions only.

Lines that begin with ">" are quoted, as deep as they have such signs. Runs of lines of one depth are passages. A
passage, and each of its lines, is normalised (lower case, white space squeezed, signs dropped) and hashed; so are the
paragraphs, lines and whole of every message's own words. Passages of every depth are joined to the latest earlier
message of their conversation that has an equal hash: `quotes` lists them all. A message replies to what its shallowest
known passage quotes: of those a whole passage counts before a single line, the longer before the shorter, the later
message before the earlier. A message that quotes nothing known replies to the message before it, the first to none.

Rows come in the order of conversation, thread (its first turn), depth of reply and turn, with the text that is left
when quoted lines, and lines that only announce a quotation (right before a quoted line; a pattern, "... wrote:" by
default) are taken out.

A conversation may be of any length: earlier messages are found by ranges of turns, so that no conversation has to
pass one task, and threads are followed by doubling jumps. Messages of any length are cut into lines and runs in one
pass. Null texts count as empty; rows without a conversation or turn are left out of linking and come first, with no
reply. Rows of equal conversation and turn are all kept, and get the same links. An empty table gives no rows. A column
of the messages that has the name of an added one is kept as <name>_given, further underscores added until it is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, written

RANGE_TURNS = 256
#: Ranges of a wider range.
WIDE_RANGES = 1024
#: What a line that announces the quotation after it ends with, in English; callers give other wordings.
ANNOUNCES = r"wrote:\s*$"
QUOTED = r"^[ \t]*>"
#: Names of the added columns.
ADDED = ("reply_to", "quoted", "quotes", "root", "depth", "own_text")


def depth_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)+)", 1), "[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:[ \t]*>)+ ?", "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def own_lines(lines: Column, announces: str = ANNOUNCES) -> Column:
    """Lines that aren't quoted and don't announce the quotation that follows."""
    told = lambda line, i: line.rlike(announces) & F.coalesce(F.get(lines, i + 1).rlike(QUOTED), F.lit(False))
    return F.filter(lines, lambda line, i: ~line.rlike(QUOTED) & ~told(line, i))


def passages(quoting: DataFrame) -> DataFrame:
    """_conv, _turn, d, lines: runs of neighbouring quoted lines of one depth, from `_lines`, each line read once."""
    cells = F.transform("_lines", lambda line: F.struct(depth_of(line).cast("int").alias("d"), unquoted(line).alias("t")))
    cut = quoting.select("_conv", "_turn", cells.alias("_cells"))
    changes = lambda i: (i == 0) | (F.get("_cells", i)["d"] != F.get("_cells", i - 1)["d"])
    cut = cut.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_cells") - 1), changes))
    stop = lambda j: F.coalesce(F.get("_starts", j + 1), F.size("_cells"))
    runs = F.transform("_starts", lambda s, j: F.struct(F.get("_cells", s)["d"].alias("d"), F.slice("_cells", s + 1, stop(j) - s)["t"].alias("lines")))
    return cut.select("_conv", "_turn", F.explode(runs).alias("r")).where("r.d > 0").select("_conv", "_turn", "r.d", "r.lines")


def messages_with_own(messages: DataFrame, conv_col: str, turn_col: str, text_col: str, announces: str = ANNOUNCES) -> DataFrame:
    """The columns by place, _conv, _turn, _text, _asks (has quoted lines), _own (lines of its own), _lines (if it quotes)."""
    conv, turn, text = (F.col(f"c{messages.columns.index(c)}") for c in (conv_col, turn_col, text_col))
    named = by_place(messages).select("*", conv.alias("_conv"), turn.alias("_turn"), F.coalesce(text, F.lit("")).alias("_text"))
    lines = F.split("_text", "\n")
    quotes = F.col("_text").rlike(f"(?m){QUOTED}")
    marked = named.select("*", quotes.alias("_asks"), lines.alias("_all"))
    return marked.select("*", F.when(F.col("_asks"), own_lines(F.col("_all"), announces)).otherwise(F.col("_all")).alias("_own"), F.when(F.col("_asks"), F.col("_all")).alias("_lines")).drop("_all")


def _before(rows: DataFrame, keys: list[str], asked: str, value: str) -> DataFrame:
    """For rows with `asked`: `found`, the greatest `value` of an earlier _turn with equal keys.

    Turns are cut into ranges and ranges into wider ones: windows look back inside a range, over the greatest values of the
    ranges before it in its wider range, and over those of the wider ranges before that. So a conversation of a thousand
    million turns has some thousands of rows in its largest window.
    """
    rows = rows.withColumn("_range", F.floor(F.col("_turn") / RANGE_TURNS)).withColumn("_wide", F.floor(F.col("_turn") / (RANGE_TURNS * WIDE_RANGES)))
    inside = Window.partitionBy(*keys, "_range").orderBy("_turn").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.max(value).over(inside)).where(asked)
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "_wide", "_range").agg(F.max(value).alias("_top"))
    far = tops.groupBy(*keys, "_wide").agg(F.max("_top").alias("_top")).withColumn("_far", F.max("_top").over(earlier(keys, "_wide"))).drop("_top")
    handed = tops.withColumn("_middle", F.max("_top").over(earlier([*keys, "_wide"], "_range"))).drop("_top")
    met = near.join(handed, [*keys, "_wide", "_range"], "left").join(far, [*keys, "_wide"], "left")
    return met.withColumn("found", F.coalesce("_near", "_middle", "_far")).drop("_range", "_wide", "_near", "_middle", "_far")


def quoted_replies(marked: DataFrame) -> DataFrame:
    """_conv, _turn, _quoted (the turn that a message answers), _links (depth and turn of all that it quotes)."""
    known = marked.where(F.col("_conv").isNotNull() & F.col("_turn").isNotNull())
    quoting = known.where("_asks")
    units = F.concat(F.array(F.struct(F.array_join("lines", "\n").alias("t"), F.lit(1).alias("w"))), F.transform("lines", lambda line: F.struct(line.alias("t"), F.lit(0).alias("w"))))
    asked = passages(quoting).select("_conv", "_turn", "d", F.explode(units).alias("u")).select("_conv", "_turn", "d", normalised(F.col("u.t")).alias("n"), F.col("u.w").alias("w"))
    # of equal quotations of one depth in messages of one turn one is asked for, the whole before a line
    rank = F.struct((-F.col("d")).alias("shallow"), F.col("w").alias("whole"), F.length("n").alias("long"))
    asked = asked.where(F.length("n") > 0).groupBy("_conv", "_turn", "d", F.sha2("n", 256).alias("_h")).agg(F.max(rank).alias("_rank")).drop("d")
    # originals of conversations that have a quotation
    convs = quoting.select("_conv").distinct()
    whole = F.array_join("_own", "\n")
    own = F.concat(F.array(whole), F.split(whole, r"\n[ \t\r]*\n\s*"), F.col("_own"))
    given = known.join(convs, "_conv", "left_semi").select("_conv", "_turn", F.explode(F.array_distinct(F.filter(F.transform(own, normalised), lambda n: F.length(n) > 0))).alias("n")).select("_conv", "_turn", F.sha2("n", 256).alias("_h"))
    none = lambda name, of: F.lit(None).cast(of.schema[name].dataType)
    both = given.distinct().select("_conv", "_turn", "_h", F.col("_turn").alias("_at"), none("_rank", asked).alias("_rank"))
    both = both.unionByName(asked.select("_conv", "_turn", "_h", none("_turn", known).alias("_at"), "_rank"))
    met = _before(both, ["_conv", "_h"], "_rank is not null", "_at").where("found is not null")
    link = F.struct((-F.col("_rank.shallow")).alias("depth"), F.col("found").alias("turn"))
    return met.groupBy("_conv", "_turn").agg(F.max(F.struct("_rank", "found"))["found"].alias("_quoted"), F.array_sort(F.collect_set(link)).alias("_links"))


def reply_order(parents: DataFrame) -> DataFrame:
    """_conv, _turn, reply -> root and depth. Jumps double, and only messages that haven't met their thread's first go on."""
    done = parents.where("reply is null").select("_conv", "_turn", F.col("_turn").alias("root"), F.lit(0).cast("long").alias("depth"))
    going = written(parents.where("reply is not null").select("_conv", "_turn", F.col("reply").alias("_up"), F.lit(1).cast("long").alias("depth")), "threads")
    while going.limit(1).count():
        met = done.select("_conv", F.col("_turn").alias("_up"), F.col("root").alias("_root"), F.lit(None).cast(parents.schema["_turn"].dataType).alias("_next"), F.col("depth").alias("_more"))
        above = met.unionByName(going.select("_conv", F.col("_turn").alias("_up"), F.lit(None).cast(parents.schema["_turn"].dataType).alias("_root"), F.col("_up").alias("_next"), F.col("depth").alias("_more")))
        jumped = written(going.join(above, ["_conv", "_up"]).select("_conv", "_turn", "_root", F.col("_next").alias("_up"), (F.col("depth") + F.col("_more")).alias("depth")), "threads")
        done = done.unionByName(jumped.where("_root is not null").select("_conv", "_turn", F.col("_root").alias("root"), "depth"))
        going = jumped.where("_root is null").drop("_root")
    return done


def _free(name: str, taken: list[str]) -> str:
    """A name for a column of the messages that none of ours and none of theirs has."""
    if name not in ADDED:
        return name
    name += "_given"
    while name in taken:
        name += "_"
    return name


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", announces: str = ANNOUNCES) -> DataFrame:
    """All columns of the messages, ordered, with reply_to, quoted (by a quotation), quotes, root, depth and own_text."""
    marked = messages_with_own(messages, conv_col, turn_col, text_col, announces)
    keyed = F.col("_conv").isNotNull() & F.col("_turn").isNotNull()
    turns = marked.where(keyed).select("_conv", "_turn").distinct()
    before = _before(turns.withColumn("_at", F.col("_turn")), ["_conv"], "true", "_at").select("_conv", "_turn", F.col("found").alias("_previous"))
    parents = before.join(quoted_replies(marked), ["_conv", "_turn"], "left").select("_conv", "_turn", F.coalesce("_quoted", "_previous").alias("reply"), F.col("_quoted").isNotNull().alias("quoted"), F.col("_links").alias("quotes"))
    parents = written(parents, "replies")
    placed = parents.join(reply_order(parents), ["_conv", "_turn"]).select("_conv", "_turn", *[F.col(c).alias(f"_{c}") for c in ("reply", "quoted", "quotes", "root", "depth")])
    # rows without a key take no part in the join: they would all meet in one task
    alone = marked.where(~keyed)
    out = marked.where(keyed).join(placed, ["_conv", "_turn"], "left").unionByName(alone, allowMissingColumns=True)
    own = F.trim(F.regexp_replace(F.array_join("_own", "\n"), r"\n{3,}", "\n\n"))
    links = F.coalesce("_quotes", F.array().cast(placed.schema["_quotes"].dataType))
    values = [F.col("_reply"), F.coalesce("_quoted", F.lit(False)), links, F.col("_root"), F.coalesce("_depth", F.lit(0)), F.when(F.col("_asks"), own).otherwise(F.col("_text"))]
    kept = [F.col(f"c{i}").alias(_free(c, messages.columns)) for i, c in enumerate(messages.columns)]
    return out.orderBy("_conv", "_root", "_depth", "_turn").select(*kept, *[v.alias(name) for name, v in zip(ADDED, values, strict=True)])
