"""Mixing sources to target shares by weighted sampling without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import TOKENIZER_DIR, token_counts
from millrace.session import cut

#: Parts into which the keys of a source are summed: so many to each doubling of the key first, so many in each further round.
OCTAVE, SLICES = 64, 1024
#: Documents that one task puts in order.
LEAF = 1_000_000


def quality(text: str = "text") -> Column:
    """A document's sampling weight, 0.1 to 1: the share of letters among its visible characters times that of distinct lines among its lines."""
    visible = F.length(F.regexp_replace(F.col(text), r"\s+", ""))
    letters = F.length(F.regexp_replace(F.col(text), r"[^\p{L}\p{M}]+", ""))
    lines = F.filter(F.split(F.col(text), r"[\r\n]+"), lambda x: F.length(F.trim(x)) > 0)
    share = letters / F.nullif(visible, F.lit(0)) * F.size(F.array_distinct(lines)) / F.nullif(F.size(lines), F.lit(0))
    return F.greatest(F.lit(0.1), F.coalesce(share, F.lit(0.0)))


def source_budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: ``source``, ``target_share``, ``max_repeats``, ``available``, ``budget``, ``epochs``, ``rest``.

    ``sizes`` has ``source`` and ``tokens`` per source. Shares of the sources that have tokens are raised alike until
    they make up the whole; the mixture is the largest in which each of them still has its share with its documents
    used ``max_repeats`` times at most. A source without tokens has a budget of 0.
    """
    have = targets.join(sizes.withColumnRenamed("tokens", "available"), "source", "left").fillna(0, ["available"])
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    whole = Window.partitionBy(F.lit(0))  # as many rows as targets
    have = have.withColumn("_share", F.when(usable, F.col("target_share")) / F.sum(F.when(usable, F.col("target_share"))).over(whole))
    have = have.withColumn("_total", F.min(F.col("available") * F.col("max_repeats") / F.col("_share")).over(whole))
    budget = F.least(F.round(F.col("_share") * F.col("_total")).cast("long"), F.col("available") * F.col("max_repeats"))
    have = have.withColumn("budget", F.when(F.col("_share").isNotNull(), budget).otherwise(F.lit(0).cast("long")))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")
    return have.withColumn("epochs", epochs).select(
        "source", "target_share", "max_repeats", "available", "budget", "epochs", (F.col("budget") - F.col("epochs") * F.col("available")).alias("rest")
    )


def last_slices(docs: DataFrame, budgets: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``source``, ``epochs``, ``_low``, ``_high``, ``_room``: the range of keys in which a source's budget ends, and what is left for it there.

    Documents (``source``, ``tokens``, ``_order``) fall into slices of their keys, of which only totals are summed up in
    order; the slice in which the budget ends is cut again until it holds ``leaf`` documents at most, so that what a task
    sorts does not grow with the corpus. A source whose budget ends on whole epochs has an empty range.
    """
    state = budgets.select("source", "epochs", F.lit(0.0).alias("_low"), F.lit(float("inf")).alias("_high"), F.col("rest").alias("_room"), F.lit(-1).cast("long").alias("_n"))
    place = F.floor(F.log2(1 + F.col("_order") * 1024) * OCTAVE)
    while True:
        inside = docs.join(state, "source").where(F.col("_order").between(F.col("_low"), F.col("_high")))
        totals = inside.groupBy("source", place.alias("_slice")).agg(
            F.sum("tokens").alias("_sum"), F.count("*").alias("_count"), F.min("_order").alias("_least"), F.max("_order").alias("_most")
        )
        upto = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # some 1,200 rows
        totals = totals.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum"))
        ending = state.select("source", "epochs", "_room").join(totals, "source").where("_room > _before and _room <= _before + _sum")
        ending = ending.select("source", "epochs", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_room") - F.col("_before")).alias("_room"), F.col("_count").alias("_n"))
        none = state.where("_room <= 0").select("source", "epochs", F.lit(-1.0).alias("_low"), F.lit(-1.0).alias("_high"), "_room", "_n")
        state = cut(ending.unionByName(none))
        if state.where((F.col("_n") > leaf) & (F.col("_low") < F.col("_high"))).isEmpty():
            return state
        place = F.floor((F.col("_order") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300)) * (SLICES - 1))


def mix_sources(
    df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, seed: int = 17,
    weight: Column | None = None, leaf: int = LEAF,
) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): the documents used with their ``repeats``, and per target the share that came out.

    ``targets`` has one row per ``source`` with ``target_share`` and ``max_repeats``; it is a table of settings and
    broadcast when Spark finds it small. Each source first gives complete epochs of all its documents, then a part
    of one more: documents in the order of exponential keys -ln(u) / weight (Efraimidis and Spirakis), u being a hash
    of seed and key, up to the one whose middle the budget reaches. ``weight`` is a positive column of ``df``, such as
    the score of a quality model (null counts as 0.1); by default ``quality``. No source is ever sorted as a whole
    (``last_slices``).

    Documents of sources that have no target, null source among them, and documents without tokens (null and empty
    texts) are not used. Equal keys are told apart by ``key``. Targets without documents come out with 0 tokens. Empty
    tables give empty results; repeated rows count each.
    """
    weighed = df.where(F.col("source").isNotNull() & (F.length(text) > 0)).join(targets.select("source"), "source", "left_semi").withColumn("_weight", F.coalesce(weight if weight is not None else quality(text), F.lit(0.1)).cast("double"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    docs = token_counts(weighed, [key, "source", "_weight"], text, tokenizer, folder).where("tokens > 0")
    docs = cut(docs.select(key, "source", "tokens", (-F.log(u) / F.col("_weight")).alias("_order")))
    budgets = source_budgets(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets)

    placed = docs.join(last_slices(docs, budgets, leaf), "source")
    ends_here = F.col("_order").between(F.col("_low"), F.col("_high"))
    within = Window.partitionBy("source").orderBy("_order", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of the last slice
    split = placed.where(ends_here).withColumn("_upto", F.sum("tokens").over(within))
    split = split.withColumn("repeats", F.col("epochs") + ((F.col("_upto") - F.col("tokens") / 2) <= F.col("_room")).cast("int")).drop("_upto")
    whole = placed.where(~ends_here).withColumn("repeats", F.col("epochs") + (F.col("_order") < F.col("_low")).cast("int"))
    chosen = split.unionByName(whole).where("repeats > 0").select(key, "source", "tokens", "repeats")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"))
    shares = budgets.select("source", "target_share", "max_repeats", "available").join(used, "source", "left").fillna(0, ["used_tokens", "n_documents", "most_repeats"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    shares = shares.withColumn("actual_share", F.round(F.coalesce(F.col("used_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)), 6))
    return chosen, shares
