"""Gates, anchor sums, bands, ordering with the regional tie-break, and daily editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.money import lookup
from newsloom.operators.skew import attach_per_key, equal_keys, rank_all, running_max, top_k
from newsloom.session import cut


# --- anchors, gates and bands ----------------------------------------------------------------
def points(name: str) -> Column:
    """The anchor's points when they are a configured value, else null."""
    value = F.col("components")[name]["points"]
    return F.when(value.isin(fv.ANCHORS[name]), value)


def invalid_anchor(name: str) -> Column:
    value = F.col("components")[name]["points"]
    return F.coalesce(value.isNotNull() & ~value.isin(fv.ANCHORS[name]), F.lit(False))


def total_score() -> Column:
    """Sum of the six anchors; null as soon as one is missing or not a configured value."""
    total = points(fv.COMPONENTS[0])
    for name in fv.COMPONENTS[1:]:
        total = total + points(name)
    return total


def band(total: Column) -> Column:
    out = None
    for low, high, name in fv.BANDS:
        hit = total.between(low, high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def evaluate_gates(df: DataFrame) -> DataFrame:
    """Add gates, total_score, recommendation, disposition_reason_codes.

    Needs ``components``, ``gates`` (map of already decided gates), ``relevance_level``,
    ``critical_candidate``, ``primary_event_type``.
    """
    total = total_score()
    complete = total.isNotNull()
    level = F.col("relevance_level")
    need = F.when(level == "C", fv.MIN_TRANSMISSION_C).otherwise(fv.MIN_TRANSMISSION_A_B)
    passed = {
        "evidence": points("source_credibility") >= fv.MIN_SOURCE_CREDIBILITY,
        "materiality": points("materiality") >= fv.MIN_MATERIALITY,
        "transmission": points("investment_transmission") >= need,
        "novelty": points("novelty") >= fv.MIN_NOVELTY,
    }
    known_level = F.coalesce(level.isin(fv.RELEVANCE_LEVELS), F.lit(False))
    gate_cols = []
    for name in fv.GATE_NAMES:
        given = F.coalesce(F.col("gates")[name], F.lit("not_evaluated"))
        waiting = F.when(given == "not_evaluated", "review_required").otherwise(given)
        if name in passed:
            scored = F.when(passed[name], "pass").otherwise("fail")
        elif name == "relevance":
            scored = F.when(~known_level, "fail").otherwise(given)
        else:
            scored = given
        gate_cols.append(F.when(complete, scored).otherwise(waiting).alias(f"_g_{name}"))
    staged = df.withColumn("total_score", total).withColumns(
        {f"_g_{name}": col for name, col in zip(fv.GATE_NAMES, gate_cols)}
    )
    gate = {name: F.col(f"_g_{name}") for name in fv.GATE_NAMES}
    outcomes = F.array(*gate.values())
    unresolved = F.array_contains(outcomes, "review_required") | F.array_contains(outcomes, "not_evaluated")
    failed = F.array_contains(outcomes, "fail")
    invalid = F.lit(False)
    for name in fv.COMPONENTS:
        invalid = invalid | invalid_anchor(name)
    fails = F.array_sort(
        F.filter(
            F.array(*[F.when(gate[n] == "fail", fv.GATE_REASONS[n]) for n in fv.GATE_NAMES]), lambda r: r.isNotNull()
        )
    )
    only = lambda code: F.array(F.lit(code))
    review_codes = F.when(F.size(fails) > 0, fails).otherwise(only("conflicting_evidence"))
    review_codes = F.when(invalid, F.array_sort(F.array_union(review_codes, only("draft_invalid")))).otherwise(review_codes)
    in_band = band(F.col("total_score"))
    band_codes = F.when(in_band.isin("suppress", "reserve_manual_only"), only("below_band")).otherwise(only("shortlisted"))
    recommendation = F.when(unresolved, "review_required").when(failed, "suppress").otherwise(in_band)
    codes = F.when(unresolved, review_codes).when(failed, fails).otherwise(band_codes)
    critical = F.coalesce(
        F.col("critical_candidate") & F.col("primary_event_type").isin(fv.CRITICAL_REVIEW_TYPES), F.lit(False)
    )
    staged = staged.withColumn("_rec", recommendation).withColumn("_codes", codes)
    surfaced = F.when(
        critical & F.col("_rec").isin("suppress", "reserve_manual_only"), "review_required"
    ).otherwise(F.col("_rec"))
    return (
        staged.withColumn(
            "gates", F.map_from_arrays(F.array(*[F.lit(n) for n in fv.GATE_NAMES]), F.array(*gate.values()))
        )
        .withColumn("recommendation", surfaced)
        .withColumn(
            "disposition_reason_codes",
            F.when(critical, F.array_sort(F.array_union("_codes", only("critical_review")))).otherwise(F.col("_codes")),
        )
        .drop("_rec", "_codes", *[f"_g_{n}" for n in fv.GATE_NAMES])
    )


def is_critical(codes: Column) -> Column:
    return F.coalesce(F.array_contains(codes, "critical_review"), F.lit(False))


# --- regional share --------------------------------------------------------------------------
def europe_share(history: DataFrame, region: str = "primary_region") -> DataFrame:
    """Europe over all published events, 0.0 for an empty history."""
    return history.agg(
        F.coalesce(F.avg((F.col(region) == "Europe").cast("int")), F.lit(0.0)).alias("europe_share")
    )


# --- ordering --------------------------------------------------------------------------------
def base_order() -> list[Column]:
    """Critical first, then score (missing counts as 0), then id."""
    return [
        F.when(is_critical(F.col("disposition_reason_codes")), 0).otherwise(1).asc(),
        F.coalesce("total_score", F.lit(0)).desc(),
        F.col("event_id").asc(),
    ]


def ablation_order() -> list[Column]:
    anchor = lambda n: F.coalesce(F.col("components")[n]["points"], F.lit(0))
    return [
        F.when(is_critical(F.col("disposition_reason_codes")), 0).otherwise(1).asc(),
        anchor("materiality").desc(),
        anchor("investment_transmission").desc(),
        anchor("portfolio_fit").desc(),
        F.col("event_id").asc(),
    ]


def tie_break(ranked: DataFrame, scope: list[str], rank_col: str = "base_rank") -> DataFrame:
    """Add ``tie_rank``: the order after one left-to-right pass of adjacent regional swaps.

    In such a pass only a non-European, non-critical event ever moves right.  It carries past the
    Europeans directly behind it for as long as each has the same recommendation, is not critical and
    lies within five points, and stops at the first that does not; those it passes move up one place.
    So each run "one other event, then Europeans" is independent: its head is the last non-European at
    or before a row, and a European is passed when no row of its run so far blocks.

    Both are running maxima over ranks, computed in blocks, so a scope with a third of all rows is
    spread over many tasks.  Only the heads need a look ahead: the number of rows they passed.
    """
    europe = F.coalesce(F.col("primary_region") == "Europe", F.lit(False))
    rows = ranked.withColumns(
        {
            "_eu": europe,
            "_crit": is_critical(F.col("disposition_reason_codes")),
            "_score": F.coalesce("total_score", F.lit(0)),
        }
    )
    # The rank leads the struct, so the largest struct is the latest head, with all a follower needs.
    head = F.struct(F.col(rank_col).alias("k"), F.col("_crit").alias("c"), F.col("_score").alias("s"), F.col("recommendation").alias("r"))
    rows = running_max(rows, scope, rank_col, F.when(~F.col("_eu"), head), "_lead")
    blocks = (
        F.col("_lead.c")
        | F.col("_crit")
        | ~F.col("recommendation").eqNullSafe(F.col("_lead.r"))
        | ((F.col("_lead.s") - F.col("_score")) > fv.TIE_BREAK_POINTS)
    )
    follower = F.col("_eu") & F.col("_lead").isNotNull()
    rows = running_max(rows, scope, rank_col, F.when(follower & blocks, F.col(rank_col)), "_blocker")
    passed = follower & ~F.coalesce(F.col("_blocker") > F.col("_lead.k"), F.lit(False))
    rows = rows.withColumn("_passed", passed)
    moved = (
        rows.filter("_passed")
        .groupBy(*scope, F.col("_lead.k").alias(rank_col))
        .agg(F.count("*").alias("_moved"))
    )
    # One row per (scope, rank) on both sides: no key repeats.
    same = [*scope, rank_col]
    moved = moved.select(*[F.col(k).alias(f"_m{k}") for k in same], "_moved")
    rows = rows.join(moved, equal_keys(same, [f"_m{k}" for k in same]), "left")
    tie_rank = F.when(F.col("_passed"), F.col(rank_col) - 1).otherwise(F.col(rank_col) + F.coalesce("_moved", F.lit(0)))
    return rows.select(*ranked.columns, tie_rank.alias("tie_rank"))


def rank_decisions(decisions: DataFrame, scope: list[str] | None = None, history: DataFrame | None = None) -> DataFrame:
    """Order decisions; the tie-break is off once Europe holds its target share of the history.

    Adds ``base_rank`` and ``position``.
    """
    scope = scope or []
    ranked = rank_all(decisions, base_order(), scope, "base_rank")
    swapped = cut(tie_break(ranked, scope), "ranked")
    if history is None:
        return swapped.withColumn("position", F.col("tie_rank")).drop("tie_rank")
    # One row: safe to attach to every row by broadcast.
    share = F.broadcast(europe_share(history))
    chosen = F.when(F.col("europe_share") >= fv.EUROPE_TARGET, F.col("base_rank")).otherwise(F.col("tie_rank"))
    return swapped.join(share, F.lit(True), "left").withColumn("position", chosen).drop("tie_rank", "europe_share")


# --- editions --------------------------------------------------------------------------------
def select_edition(ranked: DataFrame, scope: list[str], position: str = "position", capacity: int = fv.EDITION_TARGET_MAX) -> DataFrame:
    """Add ``slot``: selected, overflow, urgent_review or none, per scope.

    The capacity-th shortlisted position per scope comes from a top-k (k rows per task and scope), so
    the verdict of every other row is one comparison.
    """
    listed = F.col("recommendation").isin(fv.SELECTED_RECOMMENDATIONS)
    crit = is_critical(F.col("disposition_reason_codes"))
    rows = ranked.withColumn("_listed", F.coalesce(listed, F.lit(False)))
    cols = [*scope] or ["_all"]
    if not scope:
        rows = rows.withColumn("_all", F.lit(0))
    best = top_k(rows.filter("_listed").select(*cols, position), cols, [F.col(position).asc()], capacity, "_k")
    last = best.groupBy(*cols).agg(F.max(position).alias("_limit"))
    sizes = rows.groupBy(*cols).agg(F.count("*").alias("_n"))
    rows = attach_per_key(rows, sizes.join(last, cols, "left"), cols, "_n")
    slot = (
        F.when(crit & ~F.col("_listed"), "urgent_review")
        .when(F.col("_listed") & ((F.col(position) <= F.col("_limit")) | crit), "selected")
        .when(F.col("_listed"), "overflow")
        .otherwise("none")
    )
    return rows.withColumn("slot", slot).drop("_listed", "_limit", "_n", *([] if scope else ["_all"]))


def editions_by_day(
    decisions: DataFrame, day: str = "day", scope: list[str] | None = None, prior: tuple[int, int] = (0, 0)
) -> DataFrame:
    """Rank and select every day on its own; the regional history rolls forward from day to day.

    A day's tie-break depends on what earlier days selected, but only through two counts.  So both
    outcomes of every day (tie-break on and off) are computed in parallel, reduced to (selected,
    selected in Europe) per day, and only that short per-day list is folded in date order to learn which
    outcome is real.  Undated decisions come back with slot ``undated``.

    ``prior``: (published events, of which Europe) before the first day.
    """
    scope = scope or []
    dated = decisions.filter(F.col(day).isNotNull())
    keys = [*scope, day]
    ranked = cut(tie_break(rank_all(dated, base_order(), keys, "base_rank"), keys), "ranked-days")
    plain = select_edition(ranked, keys, "base_rank").withColumnRenamed("slot", "_slot_plain")
    both = select_edition(plain, keys, "tie_rank").withColumnRenamed("slot", "_slot_tie")
    eu = F.coalesce(F.col("primary_region") == "Europe", F.lit(False))
    count = lambda c: F.sum(c.cast("int"))
    daily = both.groupBy(*keys).agg(
        count(F.col("_slot_plain") == "selected").alias("np"),
        count((F.col("_slot_plain") == "selected") & eu).alias("ep"),
        count(F.col("_slot_tie") == "selected").alias("nt"),
        count((F.col("_slot_tie") == "selected") & eu).alias("et"),
        F.count("*").alias("_day_n"),
    )
    # One small struct per calendar day: the list is as long as the calendar, not as the data.
    fold_in = F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), "np", "ep", "nt", "et", "_day_n")))
    start = F.struct(
        F.lit(prior[0]).cast("long").alias("n"),
        F.lit(prior[1]).cast("long").alias("e"),
        F.array().cast("array<boolean>").alias("on"),
    )

    def step(acc, x):
        share = F.when(acc["n"] > 0, acc["e"] / acc["n"]).otherwise(0.0)
        on = share < fv.EUROPE_TARGET
        return F.struct(
            (acc["n"] + F.when(on, x["nt"]).otherwise(x["np"])).cast("long").alias("n"),
            (acc["e"] + F.when(on, x["et"]).otherwise(x["ep"])).cast("long").alias("e"),
            F.array_append(acc["on"], on).alias("on"),
        )

    folded = daily.groupBy(*scope).agg(fold_in.alias("days")).withColumn("f", F.aggregate("days", start, step))
    flags = folded.select(
        *scope, F.explode(F.arrays_zip(F.col("days"), F.col("f.on").alias("on"))).alias("z")
    ).select(*scope, F.col("z.days.d").alias(day), F.col("z.on").alias("_on"), F.col("z.days._day_n").alias("_day_n"))
    out = attach_per_key(both, flags, keys, "_day_n")
    dated_out = out.withColumns(
        {
            "position": F.when(F.col("_on"), F.col("tie_rank")).otherwise(F.col("base_rank")),
            "slot": F.when(F.col("_on"), F.col("_slot_tie")).otherwise(F.col("_slot_plain")),
        }
    ).drop("_on", "_day_n", "_slot_plain", "_slot_tie", "tie_rank")
    undated = decisions.filter(F.col(day).isNull()).withColumns(
        {
            "base_rank": F.lit(None).cast("long"),
            "position": F.lit(None).cast("long"),
            "slot": F.lit("undated"),
        }
    )
    return dated_out.unionByName(undated)


def edition_summary(selected: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per edition; no minimum is enforced, a shortfall is only reported."""
    n = lambda s: F.count_if(F.col("slot") == s)
    return selected.groupBy(*keys).agg(
        n("selected").alias("selected"),
        n("overflow").alias("overflow"),
        n("urgent_review").alias("urgent_review"),
        (n("selected") < fv.EDITION_TARGET_MIN).alias("below_target"),
    )


def explain(decisions: DataFrame, reason_texts: DataFrame) -> DataFrame:
    """Bucket, band text, failed and waiting gates, and one line per reason code.

    ``reason_texts``: code, recommendation (null = any), explanation — a small dimension.
    """
    total = F.col("total_score")
    band_text = None
    for low, high, name in fv.BANDS:
        line = F.concat(total.cast("string"), F.lit(f" is in {low}–{high} ({name})"))
        band_text = F.when(total.between(low, high), line) if band_text is None else band_text.when(total.between(low, high), line)
    names = lambda *outcomes: F.array_sort(F.map_keys(F.map_filter("gates", lambda k, v: v.isin(*outcomes))))
    base = decisions.withColumns(
        {
            "bucket": lookup(fv.QUEUE_BUCKETS, F.col("recommendation")),
            "score_band": band_text,
            "failed_gates": names("fail"),
            "review_gates": names("review_required", "not_evaluated"),
        }
    )
    special = reason_texts.filter(F.col("recommendation").isNotNull()).select(
        F.col("code"), F.col("recommendation"), F.col("explanation").alias("_special")
    )
    general = reason_texts.filter(F.col("recommendation").isNull()).select("code", F.col("explanation").alias("_general"))
    lines = (
        base.select("event_id", "recommendation", F.posexplode("disposition_reason_codes").alias("pos", "code"))
        .join(special, ["code", "recommendation"], "left")
        .join(general, "code", "left")
        .groupBy("event_id")
        .agg(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            "pos",
                            "code",
                            F.coalesce("_special", "_general", F.lit("No explanation recorded.")).alias("explanation"),
                        )
                    )
                ),
                lambda x: F.struct(x["code"].alias("code"), x["explanation"].alias("explanation")),
            ).alias("reasons")
        )
    )
    return base.join(lines, "event_id", "left")


def queue_order(order_col: str = "bucket") -> list[Column]:
    at = F.array_position(F.array(*[F.lit(b) for b in fv.QUEUE_BUCKET_ORDER]), F.col(order_col))
    return [at.asc(), F.coalesce("total_score", F.lit(0)).desc(), F.col("event_id").asc()]
