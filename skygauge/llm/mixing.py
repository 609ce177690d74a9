"""Mixing sources to target weights by entropy balancing.

Each document i of source s gets a rate r_i, how often the mix should take it, between 0 and
max_repeat. Of all rates that meet the sources' token targets, sum(size_i * r_i) = T_s, those
with the least relative entropy to taking everything once are r_i = min(max_repeat,
exp(lambda_s * z_i)), z_i being the document's size over its source's mean size by tokens.
The dual in lambda is convex; Newton steps (kept in a bracket, halved where they leave it)
solve it. A step is one grouped sum over the distinct (source, size) pairs, for all sources
at once; only how many of them are unsolved comes to the driver.

Rates become whole copies in bounded groups of a source's documents, dealt by hash: in each,
from large to small, a document gets the floor or the ceiling of its rate, whichever keeps
the words taken nearer to the words due, so small documents even out what large ones left. Documents of one id and size
(null ids, repeated rows) are counted first and rounded as so many of a kind, in lots of at most LOT, which
are dealt like documents: however many they are, they spread over all groups.

Sources are ordered by code point with null last and weigh weights[0], weights[1], ... in
rotation; targets share all words by weight, none above max_repeat times its source's words, the excess being
reshared by weight. A source without words has target 0; its documents, and all others of
size 0, are taken 0 words (one copy). Null texts have size 0. Repeated rows and ids are rows
of their own. A very long text counts like any other. Only the named columns are read. Empty tables give empty results.
Nothing depends on how the table is split, so reruns agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygauge.llm.carry import row_hash
from skygauge.llm.common import exact_id, materialize, schema, word_count


@dataclass(frozen=True)
class MixConfig:
    """group_rows: about as many documents are rounded together. max_steps: Newton steps, after which an unsolved source is an error."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_repeat: float = 3.0
    tolerance: float = 1e-9
    max_steps: int = 80
    group_rows: int = 2000


#: Documents of one id and size that are rounded together.
LOT = 1000


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """df, stored, with place: each row's number in that order, from 0. Rows are sorted by ranges; one count a range is summed up in one task."""
    slices = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    slices = materialize(slices.withColumns({"_slice": F.shiftright("_row", 33), "_at": F.pmod("_row", F.lit(1 << 33))}))
    counts = slices.groupBy(F.col("_slice").alias("_s")).agg(F.count("*").alias("_n"))
    before = counts.select("_s", (F.sum("_n").over(Window.orderBy("_s")) - F.col("_n")).alias("_before"))
    return slices.join(before, F.col("_slice") == F.col("_s")).withColumn("place", F.col("_before") + F.col("_at")).drop("_row", "_slice", "_at", "_s", "_n", "_before")


def capped_targets(sources: DataFrame, config: MixConfig) -> DataFrame:
    """sources (source, total, n, z) with the weight and the target of each.

    Water filling: sources below their cap share what is left by weight, so a source is at
    its cap where the level, words per weight, reaches max_repeat * total / weight. The level
    rises from that of no full source until no further source is full; each step is one sum over the sources.
    """
    w = len(config.weights)
    placed = in_order(sources.withColumn("is_null", F.col("source").isNull()), "is_null", "source")
    weight = F.element_at(F.array(*map(F.lit, config.weights)), (F.col("place") % w + 1).cast("int"))
    filled = materialize(placed.withColumn("weight", weight).withColumn("cap", config.max_repeat * F.col("total")).withColumn("full_at", F.col("cap") / F.col("weight")))
    level, n_full = 0.0, -1
    while True:
        full = F.col("full_at") <= level if n_full >= 0 else F.lit(False)
        left = F.coalesce(F.sum("total"), F.lit(0)) - F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0))
        found = filled.agg(left.alias("left"), F.sum(F.when(~full, F.col("weight"))).alias("weights"), F.count_if(full).alias("full")).first()
        if not found["weights"] or found["full"] == n_full:
            break
        level, n_full = max(level, found["left"] / found["weights"]), found["full"]
    target = F.when(F.col("full_at") <= level, F.col("cap")).otherwise(F.col("weight") * level)
    return filled.withColumn("target", target).select("source", "total", "n", "z", "weight", "target")


def _rate(config: MixConfig):  # noqa: ANN202
    return F.least(F.lit(float(config.max_repeat)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("z"), F.lit(50.0))))


def solve(cells: DataFrame, sources: DataFrame, config: MixConfig) -> DataFrame:
    """sources with lam, the dual solution. cells: source, size, copies (documents of that size)."""
    full = F.col("target") >= config.max_repeat * F.col("total") * (1 - 1e-12)
    state = sources.select("*", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), (full | (F.col("total") == 0)).alias("done"))
    state = materialize(state.withColumn("lam", F.when(full, F.lit(1e6)).otherwise(F.lit(0.0))))
    for _ in range(config.max_steps):
        if state.where("not done").isEmpty():
            break
        open_ = state.where("not done")
        rate = _rate(config)
        inside = F.col("lam") * F.col("size") / F.col("z") < math.log(config.max_repeat)
        sums = cells.join(open_.select(F.col("source").alias("s"), "lam", "z"), cells["source"].eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(F.col("copies") * F.col("size") * rate).alias("words"),
            F.sum(F.when(inside, F.col("copies") * F.col("size") * F.col("size") / F.col("z") * rate).otherwise(0.0)).alias("slope"))
        both = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        gap = F.col("words") - F.col("target")
        done = F.col("done") | F.coalesce(F.abs(gap) <= config.tolerance * F.col("target"), F.lit(False)) | (F.col("high") - F.col("low") < 1e-13)
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        moved = both.withColumn("next", F.when(done, F.col("lam")).otherwise(step)).withColumn("low_", F.when(done, F.col("low")).otherwise(low)).withColumn("high_", F.when(done, F.col("high")).otherwise(high)).withColumn("done_", done)
        state = materialize(moved.select("source", "total", "n", "z", "weight", "target", F.col("next").alias("lam"), F.col("low_").alias("low"), F.col("high_").alias("high"), F.col("done_").alias("done")))
    if not state.where("not done").isEmpty():
        raise RuntimeError(f"rates of some sources aren't found after {config.max_steps} steps")
    return state


ROUNDED = schema("id long, no_id boolean, source string, size long, total long, target double, rate double, low long, rows long, more long")


def round_rates(group: pd.DataFrame) -> pd.DataFrame:
    """Copies of a group's documents, from the largest to the smallest, carrying what is due: of each kind all rows get low copies, and some one more."""
    group = group.sort_values(["size", "place", "id"], ascending=[False, True, True], kind="stable")
    due, lows, mores = 0.0, [], []
    for size, rate, rows in zip(group["size"].tolist(), group["rate"].tolist(), group["rows"].tolist(), strict=True):
        low = math.floor(rate + 1e-9)
        part = max(0.0, rate - low)
        more = 0
        if part > 1e-9 and size:
            due += part * size * rows
            more = min(rows, max(0, math.ceil(due / size - 0.5)))
            due -= size * more
        lows.append(low)
        mores.append(more)
    return group.assign(low=np.array(lows, dtype=np.int64), more=np.array(mores, dtype=np.int64))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", config: MixConfig | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies and taken (copies times size) of each document."""
    config = config or MixConfig()
    rows = docs.select(*exact_id(id_col), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    rows = materialize(rows.groupBy("source", "id", "no_id", "size").agg(F.count("*").alias("rows")))
    cells = materialize(rows.where("size > 0").groupBy("source", "size").agg(F.sum("rows").alias("copies")))
    squares = cells.groupBy("source").agg((F.sum(F.col("copies") * F.col("size") * F.col("size").cast("double")) / F.sum(F.col("copies") * F.col("size"))).alias("z"))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("total"), F.sum("rows").alias("n"))
    sources = sizes.join(squares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "total", "n", F.coalesce("z", F.lit(1.0)).alias("z"))
    state = solve(cells, capped_targets(sources, config), config)
    found = state.select(F.col("source").alias("s"), "total", "n", "z", "target", "lam")
    lots = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / LOT)))).withColumn("rows", F.least(F.lit(LOT), F.col("rows") - LOT * F.col("lot")))
    rated = lots.join(found, lots["source"].eqNullSafe(found["s"])).withColumn("place", F.xxhash64("id", "no_id", "size", "lot"))
    groups = F.ceil(F.col("n") / config.group_rows).cast("long")
    rated = rated.select("id", "no_id", "source", "size", "rows", "place", "total", "target", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(config)).alias("rate"), F.pmod("place", groups).alias("part"))
    rounded = rated.groupBy("source", "part").applyInPandas(lambda g: round_rates(g)[ROUNDED.names], ROUNDED)
    each = rounded.withColumn("_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).withColumn("copies", F.col("low") + F.when(F.col("_no") <= F.col("more"), 1).otherwise(0))
    return each.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "size", "source", F.col("total").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document as often as the mix takes it, with its own columns.

    mixed has a row for each document by its id. Documents that share an id share its copies
    evenly; a hash of the row settles what doesn't divide.
    """
    copies = mixed.groupBy(F.col("doc_id").alias("id")).agg(F.sum("copies").alias("copies"), F.count("*").alias("same"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    each = F.col("copies") / F.col("same")
    drawn = row_hash(docs, "row").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    taken = own.join(copies, F.col("row")[id_col].eqNullSafe(F.col("id"))).select("row", F.floor(each + drawn).cast("int").alias("take"))
    return taken.where("take > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("take")))).select("row.*")
