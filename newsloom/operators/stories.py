"""Repeated headlines: cards within seven days of a story's anchor belong to that story."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.operators.skew import attach_per_key, rank_all, running_max
from newsloom.session import cut, release

WINDOW = fv.NOVELTY_WINDOW_SECONDS * 1_000_000  # times are epoch microseconds


def reviewed_anchor_hits(cards: DataFrame, anchors: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, story of cards within the window, either way, of a reviewed anchor: the first listed one.

    ``cards``: id, head, t (epoch microseconds).  ``anchors``: head, t, id, story.  That anchor is the first at or after the card's
    time less the window, so cards and anchors of a head are laid on one line, from late to early, and every card takes the
    last anchor passed: a range sort and a running maximum, whose blocks hand on what they carry.  No step has more rows than
    cards and anchors, however many of either share a head.
    """
    spots = anchors.select("head", F.col("t").alias("pos"), F.lit(0).alias("asks"), "id", "t", "story")
    asks = cards.select("head", (F.col("t") - window).alias("pos"), F.lit(1).alias("asks"), "id", "t", F.lit(None).cast(anchors.schema["story"].dataType).alias("story"))
    line = spots.unionByName(asks).filter(F.col("head").isNotNull())
    placed = rank_all(line, [F.col("pos").desc(), F.col("asks").asc(), F.col("id").desc()], ["head"], "_place")
    passed = F.when(F.col("asks") == 0, F.struct("_place", F.col("t").alias("at"), "story"))
    seen = running_max(placed, ["head"], "_place", passed, "_last")
    return seen.filter((F.col("asks") == 1) & (F.col("_last.at") <= F.col("t") + window)).select("id", F.col("_last.story").alias("story"))


def _followers(times: DataFrame, window: int) -> DataFrame:
    """head, t, next: for every distinct time of a head its first time beyond the window (null at the end).

    That time lies in the cell after its own, or is the first of the next cell that has any: one ordered pass per
    (head, cell), and one over the cells of a head, which the calendar bounds.
    """
    cell = F.floor(F.col("t") / window)
    in_cells = times.select("head", "t", cell.alias("cell"))
    edge = Window.partitionBy("head").orderBy("cell").rowsBetween(1, 1)
    starts = in_cells.groupBy("head", "cell").agg(F.min("t").alias("lo")).select("head", "cell", "lo", F.min("lo").over(edge).alias("after"))
    here = in_cells.select("head", "cell", F.col("t").alias("pos"), F.lit(0).alias("asks"), F.col("t").alias("value"), F.lit(None).cast("long").alias("t"))
    asks = in_cells.select("head", (F.col("cell") + 1).alias("cell"), (F.col("t") + window).alias("pos"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("value"), "t")
    # From late to early: Spark runs through the whole rest of a frame that ends unbounded again for every row.
    later = Window.partitionBy("head", "cell").orderBy(F.col("pos").desc(), F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = here.unionByName(asks).withColumn("inside", F.min("value").over(later)).filter("asks = 1").select("head", "t", "cell", "inside")
    known = starts.select(F.col("head").alias("_h"), F.col("cell").alias("_c"), F.col("after").alias("_after"))
    joined = found.join(known, (F.col("head") == F.col("_h")) & (F.col("cell") == F.col("_c")), "left").withColumnRenamed("_after", "beyond").drop("_h", "_c")
    own = joined.join(known, (F.col("head") == F.col("_h")) & (F.col("cell") - 1 == F.col("_c")), "left")
    # Without rows in the cell after its own, what follows its own cell.
    filled = own.join(starts.select(F.col("head").alias("_h2"), F.col("cell").alias("_c2"), F.lit(True).alias("_full")), (F.col("head") == F.col("_h2")) & (F.col("cell") == F.col("_c2")), "left")
    following = F.coalesce("inside", F.when(F.col("_full"), F.col("beyond")).otherwise(F.col("_after")))
    return filled.select("head", "t", following.alias("next"))


def story_anchors(cards: DataFrame, window: int = WINDOW) -> DataFrame:
    """Anchors (head, anchor time): the earliest card, then each first card beyond the last one's window.

    The chain from a head's first time along the followers is marked by pointer doubling: O(log anchors) rounds of
    joins for all heads together, whatever the size of a head.
    """
    times = cut(cards.select("head", "t").distinct(), "times")
    first = times.groupBy("head").agg(F.min("t").alias("_first"))
    state = attach_per_key(_followers(times, window), first, ["head"]).withColumn("on", F.col("t") == F.col("_first")).drop("_first")
    state = cut(state, "chain")
    while not state.filter(F.col("on") & F.col("next").isNotNull()).isEmpty():
        target = state.select(F.col("head").alias("_h"), F.col("t").alias("_t"), F.col("next").alias("_n"))
        marks = state.filter(F.col("on") & F.col("next").isNotNull()).select(F.col("head").alias("_mh"), F.col("next").alias("_m")).distinct()
        leap = state.join(target, (F.col("head") == F.col("_h")) & (F.col("next") == F.col("_t")), "left")
        leap = leap.join(marks, (F.col("head") == F.col("_mh")) & (F.col("t") == F.col("_m")), "left")
        following = cut(leap.select("head", "t", F.col("_n").alias("next"), (F.col("on") | F.col("_m").isNotNull()).alias("on")), "chain")
        release(state)
        state = following
    return state.filter("on").select("head", F.col("t").alias("anchor"))


def headline_stories(
    cards: DataFrame,
    reviewed: DataFrame | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """id, story for every card with a headline key.

    ``cards``: id, head, t.  ``reviewed``: the reviewed cards with a head: id, head, t, story.  A card near
    a reviewed anchor joins that story; the others form stories named by their anchor card's id.
    """
    pending = cards
    decided = None
    if reviewed is not None:
        decided = reviewed_anchor_hits(cards, reviewed, window)
        pending = cards.join(decided.select("id"), "id", "left_anti")
    anchors = story_anchors(pending, window)
    # A card's anchor lies in its own time cell or the one before: two anchors are over a window apart.
    cell = lambda c: F.floor(F.col(c) / window)
    spots = anchors.select(
        "head", "anchor", F.explode(F.array(cell("anchor"), cell("anchor") + 1)).alias("cell")
    )
    per_cell = spots.groupBy("head", "cell").agg(F.array_sort(F.collect_list("anchor")).alias("anchors"))
    load = pending.groupBy("head", cell("t").alias("cell")).agg(F.count("*").alias("_n"))
    placed = attach_per_key(
        pending.withColumn("cell", cell("t")), per_cell.join(load, ["head", "cell"]), ["head", "cell"], "_n"
    )
    placed = placed.withColumn(
        "anchor",
        F.array_min(F.filter("anchors", lambda a: (a <= F.col("t")) & (F.col("t") - a <= window))),
    ).drop("cell", "anchors", "_n")
    names = placed.filter(F.col("t") == F.col("anchor")).groupBy("head", "anchor").agg(F.min("id").alias("story"))
    members = placed.groupBy("head", "anchor").agg(F.count("*").alias("_n"))
    named = attach_per_key(placed, names.join(members, ["head", "anchor"]), ["head", "anchor"], "_n")
    out = named.select("id", "story")
    return out if decided is None else out.unionByName(decided.select("id", "story"))
