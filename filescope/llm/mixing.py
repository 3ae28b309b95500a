"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words. Its documents are counted by exact length, each counting as often as it may
be taken; the target's share of each length is taken, and a bounded knapsack over the lengths' remaining counts fills
what is left of the target as closely as it can. Which documents of a length are taken once more than the others follows
a seeded hash. Only counts by length reach the task that plans a source, never its documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filescope.llm.common import materialize, text_tag, WORD

WEIGHTS = (1, 2, 3)
MOST = 3
#: Budgets above this are first brought down greedily; the knapsack's table has so many columns at most.
KNAPSACK = 1 << 17
#: Documents of one source and length are ranked in groups of about so many.
RANKED = 256
SEED = 42


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, tag, source, size: words by ASCII white space; null text: 0. tag has 64 bits of the text's hash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_tag(F.col(text_col)).alias("tag"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(by_source: list[tuple[str | None, int]], weights: tuple = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Each source's target: shares of all words by weight, none above `most` times its own, the excess shared anew."""
    names = sorted((s for s, _ in by_source if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if any(s is None for s, _ in by_source) else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    size = dict(by_source)
    left, free, out = float(sum(size.values())), list(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > most * size[s]]
        if not over:
            out |= {s: share * weight[s] for s in free}
            break
        for s in over:
            out[s] = float(most * size[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def _knapsack(free: dict[int, int], left: int) -> dict[int, int]:
    """How many of each length make the most words up to `left`: bit b of `reach` says that b words can be made."""
    reach, mask, steps, took = 1, (1 << (left + 1)) - 1, [], {}
    for n in sorted(free, reverse=True):
        c, k = min(free[n], left // n), 1
        while c > 0 and not reach >> left & 1:
            k = min(k, c)
            new = (reach | reach << (n * k)) & mask
            if new != reach:
                steps.append((n, k, reach))
                reach = new
            c, k = c - k, k * 2
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            took[n] = took.get(n, 0) + k
            at -= n * k
    return took


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take so that the sum is at most `budget` and as near it as found."""
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    took = {n: c * budget // total for n, c in counts.items()}
    left = budget - sum(n * c for n, c in took.items())
    free = {n: counts[n] - took[n] for n in counts if n > 0}
    for n in sorted(free, reverse=True):
        if left <= KNAPSACK:
            break
        more = min(free[n], (left - KNAPSACK // 2) // n)
        if more > 0:
            took[n] += more
            free[n] -= more
            left -= more * n
    for n, k in _knapsack(free, min(left, KNAPSACK)).items():
        took[n] += k
        left -= n * k
    if left and budget <= KNAPSACK:
        # A small source: the best of all subsets, if it is nearer than one that has its share of each length.
        best = _knapsack({n: c for n, c in counts.items() if n > 0}, budget)
        if budget - sum(n * k for n, k in best.items()) < left:
            return {n: best.get(n, 0) for n in counts}
    return took


def _plan(most: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        each = dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True))
        took = fit({size: n * most for size, n in each.items()}, int(pdf["budget"].iloc[0]))
        times = [divmod(took[size], n) for size, n in each.items()]
        pdf["passes"], pdf["extra"] = [p for p, _ in times], [x for _, x in times]
        return pdf[["source", "size", "n", "passes", "extra", "target", "source_size"]]

    return plan


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, tag, size, source_size, target, times, taken per document; taken is size times times, at most `most`.

    Null texts have size 0 and are taken with 0 words; null sources are one source, the last. Repeated rows count each;
    rows that agree in everything are taken in any order. A source whose sizes are all 0 has target 0. Extra columns
    aren't read. An empty table: no rows. The list of sources, and for each source its counts by length, are what meets
    in one place; documents of one source and length are ranked in hashed groups.
    """
    spark = docs.sparkSession
    sized = materialize(sizes(docs, id_col, text_col, source_col))
    hist = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    by_source = [(r["source"], r["words"]) for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]
    goal = targets(by_source, weights, most)
    own = dict(by_source)
    # The nearest whole number of words is what is fitted.
    table = spark.createDataFrame([(s, t, own[s], round(t)) for s, t in goal.items()], "source string, target double, source_size long, budget long")
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    planned = hist.join(table, same(hist, table, "source"), "inner").select(hist["source"], "size", "n", "target", "source_size", "budget")
    plan = materialize(planned.groupBy("source").applyInPandas(_plan(most), "source string, size long, n long, passes long, extra long, target double, source_size long"))

    key = F.xxhash64("doc_id", F.lit(seed))
    a, b = sized.alias("a"), plan.alias("b")
    dealt = a.join(b, same(sized, plan, "source", "size"), "inner").select("a.doc_id", "a.tag", "a.source", "a.size", "b.passes", "b.extra", "b.target", "b.source_size", F.pmod(key, F.ceil(F.col("b.n") / RANKED)).alias("bucket"))
    # Lengths that are taken whole or not at all need no ranks.
    ranked = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    sub = sized.join(plan.filter(ranked), same(sized, plan, "source", "size"), "left_semi")
    sub = sub.join(plan.filter(ranked).select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("n")), [F.col("source").eqNullSafe(F.col("s2")), F.col("size") == F.col("z2")]).withColumn("bucket", F.pmod(key, F.ceil(F.col("n") / RANKED)))
    before = sub.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    before = before.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("s3"), F.col("size").alias("z3"), F.col("bucket").alias("b3"), F.coalesce("before", F.lit(0)).alias("before"))
    out = dealt.join(before, [F.col("source").eqNullSafe(F.col("s3")), F.col("size") == F.col("z3"), F.col("bucket") == F.col("b3")], "left")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(key, "doc_id"))
    extra = (F.coalesce("before", F.lit(0)) + rank <= F.col("extra")).cast("long")
    times = F.col("passes") + extra
    return out.select("doc_id", "tag", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def apply(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it. Rows that repeat are taken as often as all of them are."""
    once = docs.withColumns({"_id": F.col(id_col).cast("long"), "_tag": text_tag(F.col(text_col))}).dropDuplicates(["_id", "_tag"])
    times = mixed.groupBy("doc_id", "tag").agg(F.sum("times").cast("int").alias("_times")).filter("_times > 0").withColumnsRenamed({"doc_id": "_doc", "tag": "_of"})
    both = once.join(times, once["_id"].eqNullSafe(times["_doc"]) & (once["_tag"] == times["_of"]))
    return both.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns)
