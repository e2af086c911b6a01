"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. The whole part of target / size is
taken of every document (certain copies); the rest is a fixed-size sample with
inclusion probability proportional to a document's words (certain ones capped
at 1): documents are ranked by random odds over inclusion odds and taken from
the top until the words left for the source are used.

No source is ever gathered in one task. The rank cut is found by two rounds of
histograms over the rank key, aggregated before the shuffle; only the rows of
one bin of 2**-20 of the key range per source are ordered exactly. What is
taken of a document then follows from its row and the plan of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelog.llm.common import discard, stored, unnamed, words_count

BINS = 1024
#: Tied rows that are numbered in one window.
TIE_BLOCK = 1 << 16
UNIFORM_BITS = 52


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size) -> adds target.

    Sources by code point, null last, weigh `weights` in turn and share `share`
    of all sizes; a target stops at `limit` times its source's size and the
    excess goes to the others by weight, until none is above. Filling by rising
    capacity per weight gives that fixed point in one ordered pass over the
    sources, which are as many as rows of `sizes`.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    cap = F.lit(limit) * F.col("source_size")
    ranked = ranked.withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "left_over": F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(from_here),
            "nth": F.row_number().over(order),
        }
    )
    # Sources fill up in the order of cap / weight; the first that does not fill sets the level for all after it.
    level = F.col("left_over") / F.col("weight_left")
    stop = F.min(F.when(F.col("fill") > level, F.struct("nth", level.alias("level")))).over(everything)
    ranked = ranked.withColumn("level", stop["level"])
    filled = F.col("level").isNull() | (F.col("fill") <= F.col("level"))
    return ranked.select("source", "source_size", F.when(filled, F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """In (0, 1), the same for the same parts in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit("pareto"), *parts), 64 - UNIFORM_BITS)
    return (bits.cast("double") + 0.5) / float(1 << UNIFORM_BITS)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _cut(hist: DataFrame, bin_col: str) -> DataFrame:
    """Per source, the bin in which the words taken pass `need`, and what is still needed when it begins."""
    up = Window.partitionBy("source").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("upto", F.sum("words").over(up)).where(F.col("upto") > F.col("need"))
    first = hist.groupBy("source").agg(F.min(F.struct(bin_col, (F.col("need") - F.col("upto") + F.col("words")).alias("left"))).alias("at"))
    return first.select(F.col("source").alias("s"), F.col(f"at.{bin_col}").alias(f"cut_{bin_col}"), F.col("at.left").alias("need"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(id, source, size) -> one stored row per source: s, source_size, target, certain, rest, alpha and the rank at which the sample ends.

    The sample takes ranks below (cut_bin, cut_fine), and of that cell what is
    up to `last`; of the rows that equal `last` only `spare`, if they are several.
    """
    # Words per source and size: the counts behind targets and inclusion probabilities.
    by_size = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    plan = source_targets(sizes, weights, share, limit)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A full cap must not leave a sliver of a copy behind by rounding.
    plan = plan.withColumn("certain", F.floor(ratio + 1e-9).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size"))).withColumnRenamed("source", "s")

    # Inclusion min(1, alpha * size) with sum(inclusion * size) = rest: the largest size not certain fixes alpha.
    spread = by_size.where("size > 0").join(plan, _same("source", "s"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    longer = F.coalesce(F.sum(F.col("n") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum(F.col("n").cast("double") * F.col("size") * F.col("size")).over(down.rowsBetween(0, Window.unboundedFollowing))
    spread = spread.select("source", "size", ((F.col("rest") - longer) / squares).alias("alpha"))
    alphas = spread.where((F.col("alpha") >= 0) & (F.col("alpha") * F.col("size") <= 1)).groupBy("source").agg(F.max_by("alpha", "size").alias("alpha"))
    rates = stored(plan.join(alphas, _same("source", "s"), "left").select("s", "source_size", "target", "certain", "rest", "alpha"))

    # Two rounds of histograms over the rank, then the exact order of one cell per source.
    ranked = stored(_ranked(rows, rates).where("key is not null").select("source", "key", "id", "size", "bin", "fine", F.col("rest").alias("need")))
    coarse = stored(_cut(ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need")), "bin"))
    edge = ranked.drop("need").join(coarse, _same("source", "s") & (F.col("bin") == F.col("cut_bin")))
    finer = stored(_cut(edge.groupBy("source", "fine").agg(F.sum("size").alias("words"), F.first("need").alias("need")), "fine"))
    cells = stored(coarse.select("s", "cut_bin").join(finer.select(F.col("s").alias("t"), "cut_fine", "need"), _same("s", "t"), "left").drop("t"))
    # Equal rows are one entry with a count.
    exact = ranked.drop("need").join(cells, _same("source", "s") & (F.col("bin") == F.col("cut_bin")) & (F.col("fine") == F.col("cut_fine")))
    exact = exact.groupBy("source", "key", "id", "size").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    up = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    exact = exact.withColumn("left", F.col("need") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(up), F.lit(0)))
    # Of the entry that passes the target, as many rows as come nearest to it.
    exact = exact.withColumn("spare", F.least(F.col("n"), F.round(F.col("left") / F.col("size")))).where("spare > 0")
    last = exact.groupBy("source").agg(F.max(F.struct("key", "id", "size", "n", "spare")).alias("x"))
    last = last.select(F.col("source").alias("t"), F.struct("x.key", "x.id", "x.size").alias("last"), F.when(F.col("x.spare") < F.col("x.n"), F.col("x.spare")).cast("long").alias("spare"))
    marks = cells.drop("need").join(last, _same("s", "t"), "left").drop("t").withColumnRenamed("s", "u")
    out = stored(rates.join(marks, _same("s", "u"), "left").drop("u"))
    discard(by_size, rates, ranked, coarse, finer, cells)
    return out


def _ranked(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds the rank key of each row in (0, 1), null if it is never drawn, and its bins. The plan has one row per source."""
    drawn = rows.join(rates, _same("source", "s")).drop("s")
    chance = F.least(F.lit(1.0), F.col("alpha") * F.col("size"))
    u = _uniform(F.col("id"), F.col("size"))
    odds = (u / (1 - u)) * ((1 - chance) / chance)
    live = (F.col("rest") > 0) & (F.col("size") > 0) & (chance > 0)
    drawn = drawn.withColumn("key", F.when(live, odds / (1 + odds)))
    scaled = F.least(F.floor(F.col("key") * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("int")
    return drawn.withColumn("bin", F.floor(scaled / BINS).cast("int")).withColumn("fine", (scaled % BINS).cast("int"))


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` (id, source, size and others) with source_size, target, copies and taken."""
    out = _ranked(rows, plan)
    place, border = F.struct("bin", "fine"), F.struct(F.col("cut_bin").alias("bin"), F.col("cut_fine").alias("fine"))
    entry = F.struct("key", "id", "size")
    in_cell = (place == border) & F.col("last").isNotNull()
    # Without a cut every row that can be drawn is; without a fine cut the whole bin is.
    below = F.when(F.col("cut_bin").isNull(), True).when(F.col("cut_fine").isNull(), F.col("bin") <= F.col("cut_bin")).otherwise((place < border) | (in_cell & (entry <= F.col("last"))))
    out = out.withColumn("extra", F.when(F.col("key").isNotNull() & below, 1).otherwise(0))
    # eqNullSafe by parts: a null id is equal to a null id.
    tied = F.col("spare").isNotNull() & F.col("key").eqNullSafe(F.col("last.key")) & F.col("id").eqNullSafe(F.col("last.id")) & F.col("size").eqNullSafe(F.col("last.size"))
    ties = out.where(tied)
    if not plan.where("spare is not null").isEmpty():
        # Several equal rows stand at the cut and not all are taken. They are written, and numbered by
        # file and row in the file: counts per file give each file's start, so no task sees them all.
        held = stored(ties)
        at = held.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        files = at.groupBy("source", "__file").agg(F.count("*").alias("__n"))
        before = Window.partitionBy("source").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
        starts = files.select(F.col("source").alias("__s"), F.col("__file").alias("__f"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
        # A file may hold rows of several sources: rows are numbered by their place among all rows of the file,
        # so a source is given the places from its first row on in each file.
        nth = Window.partitionBy("source", "__file", F.floor(F.col("__row") / TIE_BLOCK)).orderBy("__row")
        block = at.withColumn("__block", F.floor(F.col("__row") / TIE_BLOCK))
        inner = block.groupBy("source", "__file", "__block").agg(F.count("*").alias("__m"))
        upto = Window.partitionBy("source", "__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        inner = inner.select(F.col("source").alias("__s2"), F.col("__file").alias("__f2"), F.col("__block").alias("__b2"), F.coalesce(F.sum("__m").over(upto), F.lit(0)).alias("__inner"))
        joined = block.join(starts, _same("source", "__s") & (F.col("__file") == F.col("__f"))).join(inner, _same("source", "__s2") & (F.col("__file") == F.col("__f2")) & (F.col("__block") == F.col("__b2")))
        rank = F.col("__start") + F.col("__inner") + F.row_number().over(nth)
        ranked = joined.withColumn("extra", F.when(rank <= F.col("spare"), 1).otherwise(0)).select(*held.columns)
        out = out.where(~tied).unionByName(ranked)
    copies = F.when(F.col("size") > 0, F.col("certain") + F.col("extra")).otherwise(0)
    return out.withColumn("copies", copies.cast("int")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken, source.

    Null texts and texts without words have size 0 and are never taken. Reruns
    agree on every count. Rows that agree in id, source and size share a rank;
    if the cut falls on them, as many are taken as come nearest to the target.
    An empty table gives an empty result. `limit` is at most 2, and so is every
    document's copies. Columns other than these three are not read.
    """
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words_count(F.col(text_col)).alias("size")))
    out = _taken(rows, mix_plan(rows, weights, share, limit))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", "taken", "source")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that the mix takes, each once, with size, source_size, target, copies and taken after its columns.

    As `mix`, whose counts are a function of the row and its source's plan: rows
    are not joined by id, so repeated and null ids stay as many as they are. A
    column of `docs` with the name of a new one comes back as <name>_in.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    plain, back = unnamed(docs)
    own = [F.col(back[id_col]).alias("id"), F.col(back[source_col]).cast("string").alias("source"), words_count(F.col(back[text_col])).alias("size")]
    rows = stored(plain.select(*own))
    # A column that filters can't be pushed through: sizes are counted once for each row.
    sized = plain.select("*", *own, F.monotonically_increasing_id().alias("__at"))
    out = _taken(sized, mix_plan(rows, weights, share, limit)).where("copies > 0")
    discard(rows)
    return out.select(*(F.col(back[c]).alias(f"{c}_in" if c in new else c) for c in docs.columns), *new)
