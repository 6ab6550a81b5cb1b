"""Preference formatting: one prompt and two masked completions from paired conversations.

Turns of the chosen and the rejected conversation of a pair are set side by side by their
place. The longest common turn prefix (role and text alike) is rendered once as the prompt;
what follows on either side is its completion, with a mask that says of each turn how many
characters it has and whether they train (assistant turns do).

Everything is DataFrame expressions; turns are narrow rows until they are rendered, and only
the strings of one pair meet in one row. Defined cases: null roles and texts count as
`unknown` and empty; repeated turns are turns of their own, in order of turn, role and text;
conversations alike to the end have empty completions; a pair of which one side is missing
has an empty prompt and completion there; role marks in texts are defused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def render_turn(role: Column, text: Column) -> Column:
    defused = F.replace(text, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), F.replace(role, F.lit("|"), F.lit("/")), F.lit("|>\n"), defused, F.lit("<|end|>\n"))


def _placed(turns: DataFrame, side: int) -> DataFrame:
    t = turns.select(F.col("pair_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("turn", "role", "text"))
    return t.withColumn("place", place).withColumn("side", F.lit(side)).select("pair_id", "place", "side", "role", "text")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_prompt, prompt, chosen, chosen_mask, rejected, rejected_mask.

    chosen, rejected: turns as pair_id, turn, role, text. A mask is an array of
    (n_chars, train), a turn each.
    """
    both = _placed(chosen, 0).unionByName(_placed(rejected, 1))
    at = both.groupBy("pair_id", "place").agg(F.count("*").alias("n"), F.min(F.struct("role", "text")).alias("x"), F.max(F.struct("role", "text")).alias("y"))
    # The first place where the sides differ, or where one has ended.
    same = (F.col("n") == 2) & (F.col("x") == F.col("y"))
    ends = at.groupBy("pair_id").agg(F.min(F.when(~same, F.col("place"))).alias("parts"), F.max("place").alias("last"))
    ends = ends.select("pair_id", F.coalesce(F.col("parts") - 1, F.col("last")).alias("n_prompt"))
    rows = both.join(ends, "pair_id").where((F.col("side") == 0) | (F.col("place") > F.col("n_prompt")))
    rows = rows.withColumn("part", F.when(F.col("place") <= F.col("n_prompt"), 0).otherwise(F.col("side") + 1)).withColumn("shown", render_turn(F.col("role"), F.col("text")))
    item = F.struct("place", "shown", (F.col("role") == "assistant").alias("train"))
    parts = rows.groupBy("pair_id", "n_prompt").agg(*(F.sort_array(F.collect_list(F.when(F.col("part") == k, item))).alias(name) for k, name in enumerate(("p", "c", "r"))))
    text = lambda name: F.array_join(F.transform(name, lambda x: x["shown"]), "")
    mask = lambda name: F.transform(name, lambda x: F.struct(F.length(x["shown"]).cast("long").alias("n_chars"), x["train"].alias("train")))
    return parts.select("pair_id", F.col("n_prompt").cast("long").alias("n_prompt"), text("p").alias("prompt"), text("c").alias("chosen"), mask("c").alias("chosen_mask"), text("r").alias("rejected"), mask("r").alias("rejected_mask"))


def trained_chars(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + F.when(x["train"], x["n_chars"]).otherwise(F.lit(0).cast("long")))


def swapped_answers(turns: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations (conv_id, turn, role, text).

    Chosen: a conversation up to its last assistant turn. Rejected: the same with that turn's
    text taken from the last assistant turn of its neighbour (conv_id with the last bit
    turned). Conversations without an assistant turn are no pair. Those whose neighbour has none
    are no pair either, unless `every` is set: then they are, and the rejected side is missing.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("pair_id is not null and turn is not null")
    answer = t.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("a"))
    answer = answer.select("pair_id", F.col("a.turn").alias("last"), F.col("a.text").alias("answer"))
    other = answer.select((F.col("pair_id").bitwiseXOR(F.lit(1).cast("long"))).alias("pair_id"), F.col("answer").alias("other"))
    chosen = t.join(answer.join(other, "pair_id", "left" if every else "inner"), "pair_id").where((F.col("turn") < F.col("last")) | ((F.col("turn") == F.col("last")) & (F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) == F.col("answer"))))
    rejected = chosen.where("other is not null").withColumn("text", F.when(F.col("turn") == F.col("last"), F.col("other")).otherwise(F.col("text")))
    names = ["pair_id", "turn", "role", "text"]
    return chosen.select(names), rejected.select(names)
