"""Preference examples from pairs of conversations, with DataFrame operations only.

The turns that chosen and rejected conversation share from their start on are
rendered once, as the prompt; what follows in each is a completion, in which
the assistant's turns are trained on and all others are masked.  Results stay
in long form, one row per rendered turn, so that no conversation has to fit
into one cell; ``assemble`` joins them for conversations that do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut_lineage

#: Conversation ids of a block; only within a block are all conversations with one opening ordered together.
BLOCK = 1024


def clean_turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with an id; a null turn number comes first (-1), a null role is ``none``, a null text empty."""
    return conversations.where("conv_id is not null").select(
        "conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()


def _couples(convs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Neighbours by id within the keys, first with second, third with fourth, and who is left."""
    order = Window.partitionBy(*keys).orderBy("conv_id")
    placed = (convs.withColumn("n", F.row_number().over(order)).withColumn("mate", F.lead("conv_id").over(order))
              .where("n % 2 = 1").drop("n"))
    return (placed.where("mate is not null").select(F.col("conv_id").alias("chosen_id"), F.col("mate").alias("rejected_id")),
            placed.where("mate is null").drop("mate"))


def pair_by_opening(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Stand-in for preference labels: every conversation in one row of (chosen_id, rejected_id).

    Conversations with the same first turn are paired, first inside blocks of
    ids, then what each block has left over; those whose opening is unique are
    paired with a neighbour of their block.  The last one may have no partner.
    A common opening is thus ordered block by block and never all at once.
    """
    first = F.min(F.struct("turn", "role", "text"))
    convs = cut_lineage(turns.groupBy("conv_id").agg(first.alias("o")).select(
        "conv_id", F.sha2(F.concat_ws("\x1f", "o.role", "o.text"), 256).alias("opening"),
        F.floor(F.col("conv_id") / block).alias("block")))
    same, left = _couples(convs, ["opening", "block"])
    across, left = _couples(left, ["opening"])
    near, left = _couples(left, ["block"])
    last, left = _couples(left.withColumn("rest", F.floor(F.col("block") / block)), ["rest"])
    alone = left.select(F.col("conv_id").alias("chosen_id"), F.lit(None).cast("long").alias("rejected_id"))
    return same.unionByName(across).unionByName(near).unionByName(last).unionByName(alone)


def rendered(role: str = "role", text: str = "text"):
    return F.concat(F.lit("<|"), F.col(role), F.lit("|>\n"), F.col(text), F.lit("<|end|>\n"))


def preference_rows(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of every pair: chosen_id, rejected_id, part (prompt, chosen, rejected), turn, role, rendered, trained.

    ``turns`` is as ``clean_turns`` leaves it; rows with one turn number count
    as a set.  The prompt ends before the first turn that the two don't share
    entirely.  A chosen conversation without a partner has no prompt.  Equal
    conversations are all prompt.  Empty tables give an empty result.
    """
    pairs = cut_lineage(pairs)
    sides = pairs.select(
        "chosen_id", "rejected_id",
        F.explode(F.array(F.struct(F.lit("chosen").alias("part"), F.col("chosen_id").alias("conv_id")),
                          F.struct(F.lit("rejected").alias("part"), F.col("rejected_id").alias("conv_id")))).alias("s"))
    rows = sides.select("chosen_id", "rejected_id", "s.part", "s.conv_id").where("conv_id is not null").join(turns, "conv_id")
    # A turn that only one side has ends the common prefix.
    single = (rows.groupBy("chosen_id", "turn", "role", "text")
              .agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a = b"))
    ends = single.groupBy("chosen_id").agg(F.min("turn").alias("end"))
    placed = rows.join(ends, "chosen_id", "left")
    common = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    return (placed.withColumn("shared", common).where("not shared or part = 'chosen'")
            .select("chosen_id", "rejected_id", F.when(F.col("shared"), "prompt").otherwise(F.col("part")).alias("part"),
                    "turn", "role", rendered().alias("rendered"),
                    (~F.col("shared") & (F.col("role") == "assistant")).alias("trained")))


def assemble(rows: DataFrame) -> DataFrame:
    """One row per pair: prompt, and for each completion its text and the code-point spans that are trained on."""
    segment = F.struct("turn", "role", "rendered", "trained")
    parts = rows.groupBy("chosen_id", "rejected_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("part") == p, segment))).alias(f"{p}_turns") for p in ("prompt", "chosen", "rejected")])
    def spans(turns: str):
        def span(x, k):
            before = F.aggregate(F.slice(turns, F.lit(1), k), F.lit(0), lambda n, y: n + F.length(y["rendered"]))
            return F.struct(before.alias("start"), (before + F.length(x["rendered"])).alias("end"), x["trained"].alias("trained"))

        return F.transform(F.filter(F.transform(turns, span), lambda x: x["trained"]),
                           lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    text = {p: F.array_join(F.transform(f"{p}_turns", lambda x: x["rendered"]), "").alias(p) for p in ("prompt", "chosen", "rejected")}
    return parts.select("chosen_id", "rejected_id", *text.values(),
                        *[spans(f"{p}_turns").alias(f"{p}_trained") for p in ("chosen", "rejected")])
