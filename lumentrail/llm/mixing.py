"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size within each source. A source's target is met by whole passes over
it, plus a subset whose sizes sum to the rest of the budget: first the same share of every size (which
leaves less than one document per size), then an exact bounded-knapsack fit of what is left. Only then
are documents chosen, so many of each size, in the order of a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrail.llm.shared import checkpoint

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2
#: The last part of a budget, up to so many units, is fitted exactly.
FIT = 1 << 16
#: Documents of one source and size are ranked in hash ranges of about so many.
RANGE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their sizes sum to ``budget`` as nearly as can be found.

    Sizes are positive and ascending; the sum of ``sizes * counts`` is at least ``budget``. The sum never
    exceeds the budget unless overshooting by one smallest document is nearer.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    # leave a few of the largest documents' sizes to the exact fit, so that it has documents to choose from
    spared = min(budget, FIT // 2, 8 * int(sizes[-1]))
    take = np.floor(counts * ((budget - spared) / total)).astype(np.int64)
    left, free = budget - int((sizes * take).sum()), counts - take
    for i in range(len(sizes) - 1, -1, -1):  # large sizes first, until the exact fit can reach the rest
        if left <= FIT:
            break
        n = min(int(free[i]), (left - FIT) // int(sizes[i]) + ((left - FIT) % int(sizes[i]) > 0), left // int(sizes[i]))
        take[i] += n
        free[i] -= n
        left -= n * int(sizes[i])
    room = min(left, FIT)
    if room > 0:
        add = _knapsack(sizes, free, room)
        take += add
        left -= int((sizes * add).sum())
        free -= add
    if left > 0 and len(more := np.flatnonzero(free > 0)):
        i = more[0]
        if int(sizes[i]) - left < left:
            take[i] += 1
    return take


def _knapsack(sizes: np.ndarray, free: np.ndarray, room: int) -> np.ndarray:
    """The multiset with the largest sum within ``room``: reachability over sums, item counts in powers of two.

    For each sum the item that first reached it is kept; every item is used once on the way back, as sums
    are only ever reached from sums that earlier items reached.
    """
    by = np.full(room + 1, -1, np.int64)
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in np.flatnonzero((free > 0) & (sizes <= room))[::-1]:
        n, part = min(int(free[i]), room // int(sizes[i])), 1
        while n > 0:
            part = min(part, n)
            w = part * int(sizes[i])
            if w <= room:
                new = reach[: room + 1 - w] & ~reach[w:]
                by[w:][new] = len(items)
                reach[w:] |= new
                items.append((int(i), part))
            n -= part
            part *= 2
        if reach[room]:
            break
    add = np.zeros(len(sizes), np.int64)
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, part = items[by[at]]
        add[i] += part
        at -= part * int(sizes[i])
    return add


def targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to ``per_source(source, source_size)``.

    Weights repeat over the sources in code point order, null last. The total, ``share`` of all sizes, is
    split by weight; a target stops at ``most`` times its source's size and the excess goes to the others
    by weight. With sources in the order of size over weight those that stop come first, so running sums
    find the level of the rest. One row per source passes through one sorting task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = per_source.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    every = Window.partitionBy()
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    # the level is right at the first source that stays below its cap; before it, and if there is none, caps hold
    first = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("cap") / F.col("w"))).over(every)
    level = F.min(F.when((F.col("cap") / F.col("w") == first) & (F.col("level") * F.col("w") < F.col("cap")), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"]
    return df.withColumn("target", F.when(first.isNotNull(), F.least("cap", level * F.col("w"))).otherwise(F.col("cap"))).drop("w", "cap", "level")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42) -> DataFrame:
    """``(doc_id, size, source, source_size, target, copies, taken)`` for every row of ``docs``.

    ``size`` counts the words of the text (null: 0); ``taken`` is size times copies, at most ``most``
    passes. Documents of size 0 are taken as often as their source's whole passes. Equal ids are ranked
    further by their text's hash; rows equal in both are interchangeable, so reruns agree on the rows.
    An empty table gives an empty result.
    """
    rows = checkpoint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("rank")))
    counts = checkpoint(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per size of one source: copies that every document gets, and how many get one more."""
        pdf = pdf.sort_values("size", ignore_index=True)
        whole, target = int(pdf.source_size[0]), float(pdf.target[0])
        base = min(most, int(target // whole)) if whole else 0
        pdf["base"], pdf["more"] = base, 0
        some = pdf["size"].to_numpy() > 0
        budget = int(round(target - base * whole))
        if base < most and budget > 0 and some.any():
            pdf.loc[some, "more"] = fit(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], budget)
        return pdf[["source", "size", "n", "source_size", "target", "base", "more"]]

    planned = counts.join(goal, counts["source"].eqNullSafe(goal["source"])).drop(goal["source"]).groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, base long, more long")
    planned = checkpoint(planned.withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS)))
    # ranks within (source, size) by hash ranges: whole ranges are counted, only documents of one range are sorted together
    key = ["source", "size"]
    of = rows.alias("r").join(planned.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size"))).select("r.*", "ranges", "source_size", "target", "base", "more").withColumn("range", F.floor((F.shiftrightunsigned("rank", 32) * F.col("ranges")) / F.lit(float(1 << 32))))
    before = of.groupBy(*key, "range").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    of = of.withColumn("at", F.row_number().over(Window.partitionBy(*key, "range").orderBy("rank", "doc_id")))
    of = of.alias("o").join(before.alias("b"), F.col("o.source").eqNullSafe(F.col("b.source")) & (F.col("o.size") == F.col("b.size")) & (F.col("o.range") == F.col("b.range"))).select("o.*", "before")
    copies = F.col("base") + F.when(F.col("before") + F.col("at") <= F.col("more"), 1).otherwise(0)
    return of.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
