"""Quartiles, fences and outliers of numeric columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.profile import number_columns

#: Values of a bracket that one task puts in order, and how far beside its quantile a bracket is laid by the sketch.
LEAF, BESIDE, ACCURACY = 1_000_000, 0.0015, 10_000
QUARTILES = (0.25, 0.75)


def exact_quartiles(df: DataFrame, columns: list[str], leaf: int = LEAF) -> dict[str, tuple[float, float]]:
    """The quartiles of each of ``columns`` that has values: the least values at which a quarter and three quarters of the rows are reached.

    A mergeable sketch brackets each quartile; what is below a bracket is only counted, in the scan, and brackets are
    narrowed by further sketches until one task can order the values in them. No value outside a bracket ever moves;
    the driver keeps four numbers for each quartile.
    """
    value = {c: F.col(c).cast("double") for c in columns}
    sketch = lambda of, low, high: F.percentile_approx(of, [max(0.0, low), min(1.0, high)], ACCURACY)
    first = df.agg(*(F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)), *(sketch(value[c], q - BESIDE, q + BESIDE).alias(f"b{i}_{k}") for i, c in enumerate(columns) for k, q in enumerate(QUARTILES))).first()
    brackets = {(i, k): (*map(float, first[f"b{i}_{k}"]), math.ceil(first[f"n{i}"] * q)) for i in range(len(columns)) for k, q in enumerate(QUARTILES) if first[f"n{i}"]}
    if not brackets:
        return {}
    within = lambda i, low, high: F.when(value[columns[i]].between(low, high), value[columns[i]])
    below: dict = {}
    pending = dict(brackets)
    while pending:
        aggs: list[Column] = []
        for (i, k), (low, high, _) in pending.items():
            aggs += [F.count_if(value[columns[i]] < low).alias(f"u{i}_{k}"), F.count(within(i, low, high)).alias(f"n{i}_{k}")]
        counts = df.agg(*aggs).first()
        below |= {(i, k): counts[f"u{i}_{k}"] for i, k in pending}
        wide = {(i, k): counts[f"n{i}_{k}"] for (i, k), (low, high, _) in pending.items() if counts[f"n{i}_{k}"] > leaf and low < high}
        if not wide:
            break
        at = {(i, k): (brackets[i, k][2] - below[i, k]) / n for (i, k), n in wide.items()}
        found = df.agg(*(sketch(within(i, *brackets[i, k][:2]), q - BESIDE, q + BESIDE).alias(f"b{i}_{k}") for (i, k), q in at.items())).first()
        narrower = {(i, k): (*map(float, found[f"b{i}_{k}"]), brackets[i, k][2]) for i, k in wide}
        pending = {at: b for at, b in narrower.items() if b[:2] != brackets[at][:2]}
        brackets |= pending
    parts = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), within(i, low, high).alias("v"), F.lit(rank - below[i, k]).cast("long").alias("rank")) for (i, k), (low, high, rank) in brackets.items()]
    inside = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("v is not null").groupBy("i", "k", "v", "rank").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("i", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.withColumn("upto", F.sum("n").over(upto)).where("upto >= rank").groupBy("i", "k").agg(F.min("v").alias("v"))
    got = {(r["i"], r["k"]): r["v"] for r in reached.collect()}  # two numbers a column
    return {c: (got[i, 0], got[i, 1]) for i, c in enumerate(columns) if (i, 0) in got}


def outliers(df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = (), approximate: bool = False) -> DataFrame:
    """``column_name``, ``q1``, ``q3``, ``iqr``, ``low_fence``, ``high_fence``, ``n_outliers`` for each numeric column.

    Quartiles are the discrete ones, exact (``exact_quartiles``) or with ``approximate`` from Spark's mergeable sketch
    alone; outliers are counted in one scan against the few fences.
    Nulls take no part; a table without numeric columns, or without values, gives no row.
    """
    names = columns if columns is not None else number_columns(df, exclude)
    spark, schema = df.sparkSession, "column_name string, q1 double, q3 double, iqr double, low_fence double, high_fence double, n_outliers bigint"
    if names and approximate:
        row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), list(QUARTILES), ACCURACY).alias(f"q{i}") for i, c in enumerate(names))).first()
        quartiles = {c: tuple(row[f"q{i}"]) for i, c in enumerate(names) if row[f"q{i}"]}
    else:
        quartiles = exact_quartiles(df, names) if names else {}
    if not quartiles:
        return spark.createDataFrame([], schema)
    rows = [(c, q1, q3, q3 - q1, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, q3) in quartiles.items()]
    far = df.agg(*(F.count_if((F.col(r[0]).cast("double") < r[4]) | (F.col(r[0]).cast("double") > r[5])).alias(f"f{i}") for i, r in enumerate(rows)))
    parts = [F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("column_name", "q1", "q3", "iqr", "low_fence", "high_fence"), strict=True)), F.col(f"f{i}").alias("n_outliers")) for i, r in enumerate(rows)]
    return far.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
