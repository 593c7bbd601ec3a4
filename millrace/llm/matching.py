"""Matching records of two catalogues without a common key: sorted neighbourhoods and an assignment."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

#: Neighbours looked at on either side in each sorted order.
WINDOW = 12
#: Windows in a block of places: the more, the fewer entries move twice, and the more places are compared in vain.
BLOCK = 4
#: Edits allowed between two skeletons: this share of the longer one's length, and no more than so many.
EDIT_SHARE, MOST_EDITS = 0.2, 4
#: Edits allowed between the sorted letters of two skeletons, and the length from which swapped letters are told by them.
BAG_EDITS, SWAPS_FROM = 2, 10
#: Least share of a damaged title that must be left if day and company both agree.
DAMAGED = 0.5
#: Least confidence of a match by whole titles, and by a shortened title whose day is not known.
LEAST, LEAST_SHORTENED = 0.45, 0.75
#: Edges up to which a connected part of the graph is assigned by one task.
LOCAL = 20_000
#: Weights of the field similarities.
WEIGHTS = {"title": 0.55, "publisher": 0.15, "developer": 0.15, "day": 0.1, "genre": 0.05, "spelling": 0.15, "platform": 0.05}


def _positions(entries: DataFrame, order: list[str]) -> DataFrame:
    """``entries`` with ``pos``, their place in the total order of ``order``: a range-partitioned sort, no single task sorts all.

    Sorted rows are written before they are counted, so that places stay the same if a part is computed again; the
    parts' sizes, as many numbers as there are partitions, give their offsets.
    """
    placed = cut(entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    base = F.element_at(F.lit(offsets or [0]), (part + 1).cast("int"))
    return placed.withColumn("pos", base + row).drop("_at")


def neighbours(left: DataFrame, right: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs of texts that stand within ``window`` places of each other in some order: ``k`` (the order), ``must``, ``l``, ``r``.

    Both sides have ``orders``: an array of structs of ``must``, on which both of a pair agree, and ``text``, by which
    those of one ``must`` are sorted and which says what the entry is; a null has no place. All orders are laid behind one
    another and sorted once; equal texts are put in order by side, so that places do not depend on chance. Pairs meet by
    an equi-join on places cut into blocks of ``BLOCK`` windows, entries near an end standing in the next block too:
    every block holds few rows, so no key can become hot, and no block is all pairs of a group.
    """
    def laid(df: DataFrame, side: int) -> DataFrame:
        return df.select(F.lit(side).alias("side"), F.posexplode("orders").alias("k", "o")).where("o is not null").select("side", "k", "o.must", "o.text")

    placed = _positions(laid(left, 0).unionByName(laid(right, 1)), ["k", "must", "text", "side"])
    wide = BLOCK * window
    block, order, near = F.floor(F.col("pos") / wide), F.xxhash64("k", "must").alias("h"), F.pmod("pos", F.lit(wide))
    beside = F.array_compact(F.array(block, F.when(near < window, block - 1), F.when(near >= wide - window, block + 1)))
    a = placed.where("side = 0").select("k", "must", F.col("text").alias("l"), F.col("pos").alias("p"), block.alias("b"), order)
    b = placed.where("side = 1").select(F.col("text").alias("r"), F.col("pos").alias("q"), F.explode(beside).alias("b"), order)
    return a.join(b, ["b", "h"]).where(F.abs(F.col("p") - F.col("q")) <= window).select("k", "must", "l", "r")


def title_similarity(a: Column, b: Column) -> Column:
    """1 less the share of edits between two skeletons; null beyond the allowed edits.

    Slips of the keyboard drop, double or swap letters and seldom exchange them, so beside the edits of the text those
    of its sorted letters (its bag) are held to ``BAG_EDITS``: a lost and a doubled letter. A swap is two edits of the
    text and none of the bag, so from ``SWAPS_FROM`` letters on the allowed share does not count where the bags differ
    by one letter at most.
    """
    longer = F.greatest(F.length(a), F.length(b))
    allowed = F.least(F.lit(MOST_EDITS), F.greatest(F.lit(1), F.floor(longer * EDIT_SHARE).cast("int")))
    edits = F.levenshtein(a, b, MOST_EDITS)
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    bag = F.levenshtein(letters(a), letters(b))
    near = (edits >= 0) & ((edits == 0) | ((edits <= allowed) & (bag <= BAG_EDITS)) | ((longer >= SWAPS_FROM) & (bag <= 1)))
    return F.when(near, 1 - edits / longer)


def damaged_similarity(a: Column, b: Column) -> Column:
    """1 less the share of edits between two skeletons, of ``DAMAGED`` at least; else null."""
    share = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(share >= DAMAGED, share)


def spelling_similarity(a: Column, b: Column) -> Column:
    """1 less the share of edits between two titles as they are keyed."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def overlap_similarity(a: Column, b: Column) -> Column:
    """1 if two packed fields share a word, else 0.5, since offers leave out systems; null if either is unknown."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 1)
    known = (F.size(words(a)) > 0) & (F.size(words(b)) > 0)
    return F.when(known, F.when(F.arrays_overlap(words(a), words(b)), 1.0).otherwise(0.5))


def company_similarity(a: Column, b: Column) -> Column:
    """1 if the same, 0.8 if one is the other's beginning, else 0; null if either is unknown."""
    part = F.concat(a, F.lit(" ")).startswith(F.concat(b, F.lit(" "))) | F.concat(b, F.lit(" ")).startswith(F.concat(a, F.lit(" ")))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1.0).when(part, 0.8).otherwise(0.0))


def day_similarity(a: Column, b: Column) -> Column:
    """1 within three days, 0.7 for the same day of another year, 0.4 in the same year, else 0; null if either is unknown."""
    x, y = a.cast("date"), b.cast("date")
    same = (F.dayofmonth(x) == F.dayofmonth(y)) & (F.month(x) == F.month(y))
    return F.when(x.isNotNull() & y.isNotNull(), F.when(F.abs(F.datediff(x, y)) <= 3, 1.0).when(same, 0.7).when(F.year(x) == F.year(y), 0.4).otherwise(0.0))


def weighted(similarities: dict[str, Column]) -> Column:
    """The mean of the known similarities by ``WEIGHTS``."""
    total = sum((F.when(s.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, s in similarities.items()), F.lit(0.0))
    return sum((F.coalesce(s, F.lit(0.0)) * WEIGHTS[k] for k, s in similarities.items()), F.lit(0.0)) / total


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``left`` and ``_part``, the smallest left end of its connected part: smallest labels spread and jump until none changes."""
    ends = edges.select(left, right)
    labels = ends.select(left, F.col(left).alias("_part")).distinct()
    while True:
        spread = ends.join(labels, left).groupBy(right).agg(F.min("_part").alias("_part"))
        spread = cut(ends.join(spread, right).groupBy(left).agg(F.min("_part").alias("_part")))
        jump = spread.select(F.col(left).alias("_part"), F.col("_part").alias("_next"))
        after = cut(spread.join(jump, "_part").select(left, F.col("_next").alias("_part")).join(labels.withColumnRenamed("_part", "_was"), left))
        if after.where("_part <> _was").isEmpty():
            return after.select(left, "_part")
        labels = after.select(left, "_part")


def best_pairs(edges: list[tuple]) -> list[tuple]:
    """The pairs (left, right, weight) of ``edges`` that make the largest total one to one, by shortest augmenting paths.

    Every left end may also stay alone at weight 0; ties fall to the smaller ends.
    """
    weights: dict = {}
    for a, b, w in edges:
        weights.setdefault(a, {})[(0, b)] = w
    price: dict = {}
    holder: dict = {}
    for first in sorted(weights):
        weights[first][(1, first)] = 0.0  # alone
        far = {b: -w - price.get(b, 0.0) for b, w in weights[first].items()}
        via, done = dict.fromkeys(far, None), {}
        heap = [(d, b) for b, d in far.items()]
        heapq.heapify(heap)
        while True:
            d, b = heapq.heappop(heap)
            if b in done:
                continue
            done[b] = d
            if b not in holder:
                break
            own = weights[holder[b]]
            base = d + own[b] + price.get(b, 0.0)
            for c, w in own.items():
                if c not in done and (to := base - w - price.get(c, 0.0)) < far.get(c, float("inf")):
                    far[c], via[c] = to, b
                    heapq.heappush(heap, (to, c))
        for c, at in done.items():
            price[c] = price.get(c, 0.0) + at - d
        while via[b] is not None:
            holder[b] = holder[via[b]]
            b = via[b]
        holder[b] = first
    return [(a, b, weights[a][(k, b)]) for (k, b), a in holder.items() if k == 0]


def auction(edges: DataFrame, left: str, right: str, confidence: str, step: float) -> DataFrame:
    """A one-to-one choice of ``edges`` by bids, until nobody bids: its total is largest within ``step`` for each match.

    Each unassigned left end bids for the right end of best confidence less price, and raises its price by its lead over
    its second choice and ``step``; the highest bid takes it. All bids of a round are one aggregation. Every round
    raises a price by ``step`` at least and nobody bids above their confidence, so it ends.
    """
    held: DataFrame | None = None  # right, left, price
    while True:
        open_edges = edges
        if held is not None:
            open_edges = edges.join(held.select(left), left, "left_anti").join(held.select(right, "_price"), right, "left")
        else:
            open_edges = open_edges.withColumn("_price", F.lit(0.0))
        profit = (F.col(confidence) - F.coalesce(F.col("_price"), F.lit(0.0))).alias("_profit")
        offers = open_edges.select(left, right, F.coalesce(F.col("_price"), F.lit(0.0)).alias("_price"), profit).where("_profit > 0")
        place = F.row_number().over(Window.partitionBy(left).orderBy(F.col("_profit").desc(), right))
        top = offers.withColumn("_place", place).where("_place <= 2")  # two of each partition's rows move
        first, second = F.col("_place") == 1, F.col("_place") == 2
        ranked = top.groupBy(left).agg(*(F.max(F.when(first, F.col(c))).alias(c) for c in (right, "_price", "_profit")), F.max(F.when(second, F.col("_profit"))).alias("_second"))
        bids = ranked.select(left, right, (F.col("_price") + F.col("_profit") - F.coalesce("_second", F.lit(0.0)) + step).alias("_price"))
        won = bids.groupBy(right).agg(F.max(F.struct("_price", (-F.col(left)).alias("l"))).alias("_w")).select(right, (-F.col("_w.l")).alias(left), F.col("_w._price").alias("_price"))
        won = cut(won)
        if won.isEmpty():
            break
        held = cut(won if held is None else held.join(won.select(right), right, "left_anti").unionByName(won))
    return edges.limit(0) if held is None else edges.join(held.select(left, right), [left, right])


def assign(edges: DataFrame, left: str, right: str, confidence: str, step: float = 0.002, local: int = LOCAL) -> DataFrame:
    """A one-to-one choice of ``edges`` whose total ``confidence`` is largest, in large parts within ``step`` for each match.

    Edges whose both ends have no other edge are taken at once. Of the rest, each connected part of up to ``local``
    edges is assigned exactly by one task; larger parts are never gathered in a task, but go to an auction.

    Ties fall to the smaller ends. An empty table gives an empty result.
    """
    edges = cut(edges.select(left, right, confidence))
    alone = edges.groupBy(left).agg(F.count("*").alias("_nl")).where("_nl = 1").drop("_nl")
    single = edges.groupBy(right).agg(F.count("*").alias("_nr")).where("_nr = 1").drop("_nr")
    plain = edges.join(alone, left, "left_semi").join(single, right, "left_semi")
    contested = cut(edges.join(plain.select(left), left, "left_anti"))
    if contested.isEmpty():
        return plain
    parted = cut(contested.join(components(contested, left, right), left))
    large = cut(parted.groupBy("_part").agg(F.count("*").alias("_n")).where(F.col("_n") > local).select("_part"))

    def assigned(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(best_pairs(list(zip(part[left], part[right], part[confidence], strict=True))), columns=[left, right, confidence])

    chosen = plain.unionByName(parted.join(large, "_part", "left_anti").groupBy("_part").applyInPandas(assigned, contested.schema))
    if large.isEmpty():
        return chosen
    return chosen.unionByName(auction(parted.join(large, "_part", "left_semi").select(left, right, confidence), left, right, confidence, step))
