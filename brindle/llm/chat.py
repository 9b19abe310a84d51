"""Chat formatting: cumulative snapshots collapse into the longest conversation, in DataFrame operations only.

A chat logged after every turn leaves conversations that are prefixes of longer ones. Every turn gets a
position-salted hash of its role and text; the exclusive-or of a conversation's hashes up to a turn is its rolling
prefix hash (two of 64 bits). A conversation whose length and last hash occur as an inner prefix of another is
anti-joined away; equal conversations leave the one of the least id. What remains is rendered.

No conversation is ordered in one task, however many turns it has and whatever their numbers are. Equal turns of a conversation are one
run with a count. Runs get their positions level by level: stretches of ``STRETCH`` blocks, blocks of ``BLOCK`` turn numbers, in a block the
turn numbers, roles and ``SLICES`` slices of hash values, in a slice the hashes. A window orders the entries of one level below one entry
of the level above. Rolling hashes are summed up in pieces of ``PIECE`` positions. Runs, without texts, are written once and read for both steps.

Texts are shuffled once, those of dropped conversations too, as their turns meet the decision there; equal turns of a conversation are one text. They are put together in segments of ``SEGMENT`` turns; a conversation's rendering
is its segments one after another. A segment's text is as long as its turns are together.

Defined results: null text counts as empty, null role as "unknown". Turns go by turn number, nulls last; equal numbers by role, then
by the text's hash. Rows without a conv_id are one conversation with a null id, never the one that stays
for others equal to it. Repeated rows are turns. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut, starts
from brindle.operators.joins import spread_join

BLOCK, STRETCH, SLICES, PIECE, SEGMENT = 256, 4096, 1024, 4096, 64
START, END = "<|im_start|>", "<|im_end|>"
#: What tells the runs of a conversation apart, in their order.
RUN = ["block", "number", "role", "slice", "h1", "h2"]


def _turns(df: DataFrame) -> DataFrame:
    """Turns with defined roles and texts, the key of their conversation, their block, and their number (0 in the nulls' block)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("unknown"))
    turns = df.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("conv"),
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)), F.lit((1 << 53) // BLOCK)).cast("long").alias("block"),
        F.coalesce("turn", F.lit(0)).alias("number"),
        role.alias("role"),
        text.alias("text"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit("second"), text, role).alias("h2"),
    )
    # Slices rise with h1.
    return turns.withColumn("slice", F.shiftright("h1", 64 - (SLICES - 1).bit_length()))


def positions(df: DataFrame) -> DataFrame:
    """(conv, conv_id, RUN, n, first): every run of equal turns, how many they are and the position of the first, from 1."""
    runs = cut(_turns(df).groupBy("conv", "conv_id", *RUN).agg(F.count("*").alias("n")))
    slices = runs.groupBy("conv", *RUN[:4]).agg(F.sum("n").alias("n"))
    blocks = slices.groupBy("conv", "block").agg(F.sum("n").alias("n")).withColumn("stretch", F.floor(F.col("block") / STRETCH))
    by_stretch = starts(blocks.groupBy("conv", "stretch").agg(F.sum("n").alias("n")), ["conv"], ["stretch"])
    by_block = starts(blocks, ["conv", "stretch"], ["block"], by_stretch).drop("stretch")
    by_slice = starts(slices, ["conv", "block"], RUN[1:4], by_block)
    placed = starts(runs.withColumn("times", F.col("n")), ["conv", *RUN[:4]], RUN[4:], by_slice)
    return cut(placed.select("conv", "conv_id", *RUN, F.col("times").alias("n"), (F.col("__before") + 1).alias("first")))


def _turn_by_turn(runs: DataFrame) -> DataFrame:
    """A row with its pos for each turn of each run; runs of over ``PIECE`` turns are dealt to tasks in pieces."""
    last = lambda start, n: F.explode(F.sequence(start, F.col(n) - 1))
    zero = F.lit(0).cast("long")
    few = runs.where(F.col("n") <= PIECE).withColumn("__k", last(zero, "n"))
    pieces = runs.where(F.col("n") > PIECE).withColumn("__piece", F.explode(F.sequence(zero, F.expr(f"(n - 1) div {PIECE}"))))
    dealt = pieces.repartition("conv", "first", "__piece").withColumn("__end", F.least("n", (F.col("__piece") + 1) * PIECE))
    many = dealt.withColumn("__k", last(F.col("__piece") * PIECE, "__end")).drop("__piece", "__end")
    return few.unionByName(many).withColumn("pos", F.col("first") + F.col("__k")).drop("first", "n", "__k")


def prefixes(runs: DataFrame) -> DataFrame:
    """(conv, conv_id, pos, n_turns, p1, p2): the rolling hashes of every turn, from ``positions``."""
    piece = F.expr(f"(pos - 1) div {PIECE}").alias("piece")
    placed = _turn_by_turn(runs.select("conv", "conv_id", "h1", "h2", "first", "n")).select("conv", "conv_id", "pos", piece, F.xxhash64("pos", "h1").alias("x1"), F.xxhash64("h2", "pos").alias("x2"))
    before, whole = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv")
    pieces = placed.groupBy("conv", "piece").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.count("*").alias("n"))
    earlier = [F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0).cast("long")).alias(f"s{k}") for k in (1, 2)]
    earlier = pieces.select("conv", "piece", *earlier, F.sum("n").over(whole).alias("n_turns"))
    so_far = Window.partitionBy("conv", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.withColumns({f"p{k}": F.bit_xor(f"x{k}").over(so_far) for k in (1, 2)}).join(earlier, ["conv", "piece"])
    return rolled.select("conv", "conv_id", "pos", "n_turns", *[F.col(f"p{k}").bitwiseXOR(F.col(f"s{k}")).alias(f"p{k}") for k in (1, 2)])


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv, conv_id, n_turns, n_copies): one conversation of each text that is no prefix of a longer one, from ``prefixes``."""
    inner = rolled.where("pos < n_turns").select("pos", "p1", "p2").distinct()
    least = F.min_by(F.struct("conv", "conv_id"), F.coalesce(F.col("conv_id"), F.lit((1 << 63) - 1)))
    unique = rolled.where("pos = n_turns").groupBy("pos", "p1", "p2").agg(least.alias("x"), F.count("*").alias("n_copies"))
    return unique.join(inner, ["pos", "p1", "p2"], "left_anti").select("x.conv", "x.conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(df: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, n_copies, n_segment_turns, rendered) of every maximal conversation.

    n_turns counts the whole conversation, n_copies the conversations equal to it, itself included.
    """
    runs = positions(df)
    kept = maximal(cut(prefixes(runs))).drop("conv_id").join(runs.groupBy("conv").agg(F.count("*").alias("n_runs")), "conv")
    wanted = spread_join(runs, kept, ["conv"], "n_runs", runs.count()).drop("n_runs")
    texts = _turns(df).drop("conv_id").dropDuplicates(["conv", *RUN])
    turns = _turn_by_turn(wanted.join(texts, ["conv", *RUN])).withColumn("segment", F.expr(f"(pos - 1) div {SEGMENT}"))
    piece = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    rendered = F.array_join(F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece"))))["piece"], "").alias("rendered")
    parts = turns.groupBy("conv", "conv_id", "segment", "n_turns", "n_copies").agg(F.count("*").alias("n_segment_turns"), rendered)
    return parts.select("conv_id", "segment", "n_turns", "n_copies", "n_segment_turns", "rendered")


#: The same rows by DuckDB, comparing whole prefixes.
SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown')) AS pos,
       coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
 p AS (SELECT *, string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
 u AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY n, prefix),
 k AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = u.n AND p.prefix = u.prefix))
SELECT k.conv_id, (t.pos - 1) // {SEGMENT} AS segment, k.n AS n_turns, k.n_copies, count(*) AS n_segment_turns,
 string_agg('{START}' || t.role || chr(10) || t.text || '{END}' || chr(10), '' ORDER BY t.pos) AS rendered
FROM k JOIN t ON t.conv_id = k.conv_id GROUP BY ALL
"""
