"""Mixing sources to target weights by entropy balancing.

Each source gets a word target. Among document rates between 0 and `ceiling` copies, the method
takes those of greatest entropy relative to one copy each that meet the target: rates tilted
exponentially in the document's size, r = c / (1 + (c - 1) exp(-lambda x)). lambda solves a
convex dual; Newton steps, kept inside a bracket, run for all sources at once as distributed sums
over (source, size) classes. Rates are then rounded into whole copies, class by class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.llm.common import WORD
from mosaiq.scratch import Scratch

#: Greatest copies of a document, Newton rounds at most, relative error at which a source is solved.
CEILING, ROUNDS, TOLERANCE = 3, 60, 1e-7
#: Documents of one class that one task ranks, about.
RANKED = 2_000


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], cuts: Scratch, name: str) -> DataFrame:
    """df with, for each new column: source column of `sums`, the sum over the rows before in `order`.

    Ranges of the order are dealt to tasks; only one row per range meets in a single place. The
    order must be total, so that no two rows tie.
    """
    dealt = cuts.cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    out = dealt.withColumns({k: F.coalesce(F.sum(v).over(within), F.lit(0)) for k, v in sums.items()}).join(totals, "_part")
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_part", *[f"_{k}" for k in sums])


def targets(sizes: DataFrame, cuts: Scratch, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh as `weights`, repeating, and share the total; a
    target stops at `ceiling` times the source's size and the excess goes to the others by weight.
    That is target = min(weight * level, cap) for the level at which they sum to the total; it is
    found from prefix sums in the order of cap / weight.
    """
    named = sizes.withColumn("_last", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit(""))).withColumn("_one", F.lit(1))
    ranked = prefix_sums(named, ["_last", "_name"], {"_rank": "_one"}, cuts, "ranked")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight.cast("long")).withColumn("_cap", ceiling * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    total = ranked.agg(F.sum("source_size").alias("_total"), F.sum("_weight").alias("_weights"))
    filled = prefix_sums(ranked, ["_ratio", "_last", "_name"], {"_caps": "_cap", "_used": "_weight"}, cuts, "filled").crossJoin(F.broadcast(total))  # one row
    # The level if exactly the sources before this one were at their caps; the first that stays below its ratio holds.
    level = (F.col("_total") - F.col("_caps")) / (F.col("_weights") - F.col("_used"))
    found = filled.where(level <= F.col("_ratio")).agg(F.min(F.struct("_ratio", level.alias("level")))["level"].alias("_level"))
    out = filled.crossJoin(F.broadcast(found))  # one row
    return out.select("source", "source_size", F.least(F.col("_weight") * F.coalesce("_level", F.lit(float("inf"))), F.col("_cap").cast("double")).alias("target"))


def _rate(lam: Column, x: Column, ceiling: int) -> Column:
    # Exponents beyond 700 overflow a double.
    return ceiling / (1 + (ceiling - 1) * F.exp(F.least(F.lit(700.0), -lam * x)))


def solve_rates(classes: DataFrame, goals: DataFrame, cuts: Scratch, ceiling: int = CEILING) -> DataFrame:
    """(source, lam, unit): the dual variable of each source and the size that counts as 1.

    classes: (source, size, n). Sums run over decimals, so their order doesn't matter and reruns
    agree. A source whose target is at its cap, or 0, gets a lambda without bound.
    """
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    units = classes.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.greatest(F.lit(1), F.sum(F.when(F.col("size") > 0, F.col("n"))))).alias("unit"))
    state = goals.where("source_size > 0").join(units.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    state = state.withColumns({"lam": F.lit(0.0), "low": F.lit(-1e9), "high": F.lit(1e9), "done": (F.col("target") >= ceiling * F.col("source_size") * (1 - 1e-12)) | (F.col("target") <= 0)})
    state = state.withColumn("lam", F.when(F.col("done"), F.when(F.col("target") > 0, 1e9).otherwise(-1e9)).otherwise(0.0))
    state = cuts.cut(state, "state")
    for _ in range(ROUNDS):
        if state.where("not done").isEmpty():
            break
        busy = state.where("not done").select(F.col("source").alias("_s"), "lam", "unit")
        x = F.col("size") / F.col("unit")
        r = _rate(F.col("lam"), x, ceiling)
        sums = classes.join(busy, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(
            exact(F.col("n") * F.col("size") * r).alias("got"),
            exact(F.col("n") * F.col("size") * x * r * (1 - r / ceiling)).alias("slope"),
        )
        both = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        both = both.withColumns({"low": F.when(F.col("done"), F.col("low")).otherwise(low), "high": F.when(F.col("done"), F.col("high")).otherwise(high), "newton": F.col("lam") - F.try_divide(gap, F.col("slope")), "solved": F.col("done") | (F.abs(gap) <= TOLERANCE * F.col("target"))})
        # Outside the bracket: the middle of it, or twice as far where one end is still open.
        middle = F.when(F.col("high") >= 1e9, F.col("low") * 2 + 1).when(F.col("low") <= -1e9, F.col("high") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")) & (F.abs(F.col("newton") - F.col("lam")) < 8), F.col("newton")).otherwise(middle)
        both = both.withColumn("lam", F.when(F.col("solved"), F.col("lam")).otherwise(step)).withColumn("done", F.col("solved"))
        state = cuts.cut(both.select("source", "source_size", "target", "unit", "lam", "low", "high", "done"), "state")
    return state.select("source", "target", "lam", "unit")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), ceiling: int = CEILING) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, copies and taken (copies * size) for every row of docs.

    size counts the words of a text; null and empty texts have size 0, keep one copy and take
    nothing. A null source is a source of its own, last in order. Rows that repeat an id are rows
    of their own, told apart by the hash of the text where the texts differ. Sources without words
    have target 0. Other columns are not read, whatever their names. Rounding: a class (source, size) gets whole copies; what rounding leaves of a source's
    target is dealt out again from the smallest sizes up. Within a class, hashes of the id decide.
    """
    cuts = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long")
    narrow = cuts.cut(docs.select(docs[source].alias("source"), size.alias("size"), F.xxhash64(docs[doc_id], F.lit("mix")).alias("h"), docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash")), "sizes")
    classes = cuts.cut(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    goals = cuts.cut(targets(classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), cuts, weights, ceiling), "goals")
    solved = solve_rates(classes, goals, cuts, ceiling)
    counts = cuts.cut(_class_copies(classes, solved, ceiling), "counts")
    chosen = _deal(narrow, counts, cuts)
    out = chosen.join(goals.select(F.col("source").alias("_g"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _class_copies(classes: DataFrame, solved: DataFrame, ceiling: int) -> DataFrame:
    """(source, size, n, k): whole copies k of each class, at most ceiling * n."""
    df = classes.join(solved.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rate = _rate(F.col("lam"), F.col("size") / F.col("unit"), ceiling)
    k = F.when((F.col("size") == 0) | F.col("lam").isNull(), F.col("n")).otherwise(F.floor(F.col("n") * rate + 0.5).cast("long"))
    df = df.withColumn("k", F.least(k, ceiling * F.col("n")))
    src = W.partitionBy("source")
    up = src.orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_gap", F.coalesce("target", F.lit(0.0)) - F.sum(F.col("k") * F.col("size")).over(src))
    # Too few words: room for more copies, smallest sizes first; too many: copies to give back.
    room = F.when(F.col("size") == 0, 0).when(F.col("_gap") > 0, ceiling * F.col("n") - F.col("k")).otherwise(F.col("k"))
    df = df.withColumn("_room", room).withColumn("_before", F.coalesce(F.sum(F.col("_room") * F.col("size")).over(up), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("_room"), F.floor((F.abs("_gap") - F.col("_before")) / F.greatest(F.lit(1), F.col("size")))))
    return df.select("source", "size", "n", (F.col("k") + F.signum("_gap").cast("long") * F.when(F.col("target").isNull(), 0).otherwise(more)).cast("long").alias("k"))


def _deal(narrow: DataFrame, counts: DataFrame, cuts: Scratch) -> DataFrame:
    """Copies of each row: k // n, and one more for the k % n rows of the class with the lowest (salt, hash, id)."""
    c = counts.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "k")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    salted = narrow.join(c, same).drop("_s", "_z").withColumn("salt", F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / RANKED)))
    salted = cuts.cut(salted, "salted")
    salts = salted.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    salts = salts.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("salt").alias("_a"), before.alias("before"))
    rank = F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("h", "doc_id", "text_hash"))
    ranked = salted.withColumn("rank", rank).join(salts, same & (F.col("salt") == F.col("_a")))
    extra = (F.col("before") + F.col("rank") <= F.col("k") % F.col("n")).cast("long")
    return ranked.select("doc_id", "text_hash", "source", "size", (F.floor(F.col("k") / F.col("n")).cast("long") + extra).alias("copies"))

