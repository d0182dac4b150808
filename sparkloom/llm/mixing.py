"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Targets: sources in code point order, null last, take the given weights in turn; shares of all words
follow the weights, a target stops at ``CAP`` times its source's words, and the excess is shared again by weight.

Rates: the document rates r closest to 1 in relative entropy (the sum of r log r - r + 1), at most ``CAP``, whose words meet the
target of their source. The convex dual has one multiplier t for each source's token constraint, and its
solution tilts rates exponentially in a document's words x (over the source's mean): r = exp(t x), or ``CAP`` where that is more.
Newton's method, kept inside a bracket, finds t from sums of words and curvature over the source's documents. These depend only on how many
documents have how many words, so documents are counted by (source, words) once, and every iteration is a small distributed aggregation. If
``ITERATIONS`` don't bring every source within ``CLOSE`` of its target, that is an error.

Rounding: documents are dealt by a hash to bins of about ``BIN`` in each source; in a bin, from the
longest down, each takes the copies that bring the bin's words closest to its expected words so far.
The error left over is about half of a bin's shortest document. Rows that share id and size are told apart by a number, so they don't fill one bin.

Sums of rates are exact sums of decimals, so they don't depend on the order of rows, and reruns agree.

Defined results: a null text has no words and is never taken; a very long text is counted whole and is one document; a null source is a source of its
own; a source without words has target 0; a null doc_id is dealt like any other value; repeated rows count each; ties in a bin go by doc_id; an empty table gives
no row; extra columns are ignored. Sources themselves are ordered and shared out in one task: there is one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, is_key, partitions, with_key

WEIGHTS = (1, 2, 3)
CAP = 3
BIN = 48
ITERATIONS = 80
#: How far from its target a source's expected words may be when iterations end: as a share of it, or in words where that is more.
CLOSE, CLOSE_WORDS = 1e-7, 0.01
#: Rows of one id and size that are numbered by one task.
RUN = 1 << 16


def words(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs).

    The frame has one row per source; its order, capped sources and levels are found by windows over these rows.
    """
    n = len(weights)
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sources.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % n + 1).cast("double"))
    # Sources stop at their cap in the order of cap * size / weight; before the k-th stops, the rest share what is left.
    fill = Window.orderBy(F.col("source_size") / F.col("__w"), F.asc_nulls_last("source"))
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("__level", level).withColumn("__open", cap * F.col("source_size") >= F.col("__level") * F.col("__w"))
    first_open = F.min(F.when(F.col("__open"), F.struct((F.col("source_size") / F.col("__w")).alias("r"), "__level"))).over(everything)
    ranked = ranked.withColumn("__level", first_open["__level"])
    target = F.when(F.col("__level").isNull(), cap * F.col("source_size")).otherwise(F.least((cap * F.col("source_size")).cast("double"), F.col("__level") * F.col("__w")))
    return scratch.keep(ranked.select("source", "source_size", "docs", target.cast("double").alias("target")), "targets")


def _rate(t: Column, x: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(700.0), t * x)))


def tilts(counts: DataFrame, goals: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """(source, source_size, docs, target, mean, tilt): Newton's iterations over (source, size, docs). tilt is null where the target is at the cap."""
    open_ = goals.withColumn("mean", F.col("source_size") / F.col("docs")).withColumn("full", F.col("target") >= cap * F.col("source_size") * (1 - 1e-12))
    # Every target above its source's words asks for a positive tilt, every one below for a negative tilt.
    up = F.col("target") > F.col("source_size")
    state = open_.select(
        "source", "source_size", "docs", "target", "mean", "full", F.lit(0.0).alias("tilt"), F.when(up, 0.0).otherwise(-1e9).alias("low"), F.when(up, 1e9).otherwise(0.0).alias("high"), F.lit(1.0).alias("off")
    )
    state = scratch.keep(state, "tilt0")
    for k in range(ITERATIONS):
        at = counts.join(state, counts["source"].eqNullSafe(state["source"])).where(~F.col("full") & (F.col("size") > 0))
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("tilt"), x, cap)
        exact = lambda c: F.sum(c.cast("decimal(38,10)")).cast("double")
        sums = at.groupBy(state["source"].alias("s")).agg(exact(r * F.col("size") * F.col("n")).alias("got"), exact(F.when(r < cap, r * x * F.col("size") * F.col("n")).otherwise(0.0)).alias("slope"))
        new = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        gap = F.coalesce(F.col("got") - F.col("target"), F.lit(0.0))
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.greatest(F.col("slope"), F.lit(1e-12))
        # Outside the bracket a step is replaced: doubling towards an open end, halving between two ends.
        inner = F.when(high >= 1e9, F.greatest(low * 2, F.lit(1.0))).when(low <= -1e9, F.least(high * 2, F.lit(-1.0))).otherwise((low + high) / 2)
        fine = F.abs(gap) <= F.greatest(F.col("target") * CLOSE, F.lit(CLOSE_WORDS))
        halve = F.lit(k > 20 and k % 4 == 3) & (low > -1e9) & (high < 1e9)  # where steps are slow, so that the bracket is sure to close
        tilt = F.when(fine | F.col("full"), F.col("tilt")).when(~halve & (step > low) & (step < high) & (F.abs(step) < 1e8), step).otherwise(inner)
        new = new.select(
            state["source"], "source_size", "docs", "target", "mean", "full", tilt.alias("tilt"), low.alias("low"), high.alias("high"), F.when(fine | F.col("full"), 0.0).otherwise(F.abs(gap) / F.col("target")).alias("off")
        )
        new = scratch.keep(new, f"tilt{k + 1}")
        scratch.drop(f"tilt{k}")
        state = new
        if not state.where(F.col("off") > 0).head(1):
            break
    else:
        raise RuntimeError(f"{ITERATIONS} iterations left sources apart from their targets, by up to {state.agg(F.max('off')).first()[0]:.1e} of them")
    return state.select("source", "source_size", "docs", "target", "mean", F.when(~F.col("full"), F.col("tilt")).alias("tilt"))


def _numbered(sized: DataFrame) -> DataFrame:
    """``sized`` with a number k that tells rows of one source, id and size apart."""
    if is_key(sized):
        return sized.withColumn("k", F.lit(0).cast("long"))
    runs = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("b", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {RUN}"))))
    dealt = runs.repartition(partitions(sized.sparkSession), "doc_id", "size", "b")
    return dealt.withColumn("k", F.explode(F.sequence(F.col("b") * RUN, F.least(F.col("n"), (F.col("b") + 1) * RUN) - 1))).drop("n", "b")


def copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) from (doc_id, source, size)."""
    scratch = Scratch(sized.sparkSession)
    sized = scratch.keep(sized.select("doc_id", "source", "size"), "sized")
    counts = scratch.keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")), scratch, weights, cap)
    found = tilts(counts, goals, scratch, cap).withColumnRenamed("source", "s")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), float(cap)).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("mean"), cap))
    sized = _numbered(sized)
    rated = sized.join(found, sized["source"].eqNullSafe(found["s"])).withColumn("rate", rate)
    # Bins by a hash that many documents of one source share no more than by chance.
    bins = F.greatest(F.lit(1), F.ceil(F.col("docs") / BIN)).cast("long")
    rated = rated.withColumn("bin", F.pmod(F.xxhash64("doc_id", "size", "k"), bins))
    doc = F.struct((-F.col("size")).alias("k"), "doc_id", "rate")
    binned = rated.groupBy("source", "source_size", "target", "bin").agg(F.array_sort(F.collect_list(doc)).alias("docs"))

    def take(acc: Column, d: Column) -> Column:
        size = -d["k"]
        want = acc["want"] + d["rate"] * size
        n = F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(cap), F.round((want - acc["got"]) / size).cast("int")))).otherwise(0)
        return F.struct(want.alias("want"), (acc["got"] + n * size).alias("got"), F.concat(acc["ns"], F.array(n)).alias("ns"))

    start = F.struct(F.lit(0.0).alias("want"), F.lit(0).cast("long").alias("got"), F.array().cast("array<int>").alias("ns"))
    taken = binned.withColumn("ns", F.aggregate("docs", start, take, lambda acc: acc["ns"]))
    out = taken.select("source", "source_size", "target", F.explode(F.arrays_zip("docs", "ns")).alias("d"))
    return out.select(F.col("d.docs.doc_id").alias("doc_id"), "source", (-F.col("d.docs.k")).alias("size"), "source_size", "target", F.col("d.docs.rate").alias("rate"), F.col("d.ns").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies, rate of each document."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    c = copies(sized, weights, cap)
    return c.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate")


def apply(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with each row repeated as the mix takes it."""
    keyed = with_key(docs, Scratch(docs.sparkSession))
    n = mix(keyed, weights, cap, id_col="__key").where(F.col("copies") > 0).select(F.col("doc_id").alias("__key"), F.col("copies").alias("__copies"))
    return keyed.join(n, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
