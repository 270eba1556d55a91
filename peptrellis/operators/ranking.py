"""Ranking: objective weights from a brief, flag deductions, renormalised module scores, one global order."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import decimals

#: Brief entries and the objective modules they point to, with points.
FUNCTION_LINKS = [
    ("angiogenesis", "angiogenesis", 1.0),
    ("anti_inflammatory", "anti_inflammatory", 1.0),
    ("immunomodulation", "immunomodulation", 0.5),
    ("antimicrobial", "antimicrobial", 1.0),
    ("cell_proliferation/migration", "wound_closure", 1.0),
    ("fibroblast_migration", "wound_closure", 1.0),
    ("keratinocyte_migration", "wound_closure", 1.0),
    ("collagen_remodeling", "collagen_ecm", 1.0),
    ("collagen_synthesis", "collagen_ecm", 1.0),
]
CONTEXT_LINKS = [
    ("infected", "antimicrobial", 0.5),
    ("infected", "immunomodulation", 0.5),
    ("biofilm_positive", "antimicrobial", 0.5),
    ("biofilm_positive", "immunomodulation", 0.5),
    ("necrotic", "antimicrobial", 0.5),
    ("necrotic", "wound_closure", 0.5),
    ("necrotic", "immunomodulation", 0.5),
    ("chronic", "anti_inflammatory", 0.5),
    ("chronic", "immunomodulation", 0.5),
    ("chronic", "wound_closure", 0.5),
    ("diabetic", "anti_inflammatory", 0.5),
    ("diabetic", "immunomodulation", 0.5),
    ("diabetic", "angiogenesis", 0.5),
    ("diabetic", "wound_closure", 0.5),
    ("high_glucose", "anti_inflammatory", 0.5),
    ("ischemic", "angiogenesis", 0.5),
    ("low_perfusion", "angiogenesis", 0.5),
    ("acute", "wound_closure", 0.5),
    ("surgical", "wound_closure", 0.5),
    ("traumatic", "wound_closure", 0.5),
    ("clean", "wound_closure", 0.5),
    ("burn", "anti_inflammatory", 0.5),
    ("radiation_induced", "anti_inflammatory", 0.5),
]
PATHOGEN_LINK = ("antimicrobial", 1.0)
#: Deductions (module, flag, line, limit, centre) of numeric flags, and (module, flag, level, deduction) of others.
NUMERIC_FLAGS = [
    ("safety", "net_charge", -5.0, -10.0, None),
    ("safety", "net_charge", 9.0, 14.0, None),
    ("safety", "hydrophobic_moment", 0.5, 1.0, None),
    ("safety", "amphipathicity", 0.8, 1.0, None),
    ("stability", "instability_index", 40.0, 100.0, None),
    ("stability", "aggregation", 0.6, 0.7, None),
    ("stability", "solubility", 0.4, 0.0, None),
    ("stability", "isoelectric_point", 0.5, 0.0, 7.4),
]
LEVEL_FLAGS = [
    ("stability", "oxidation_risk", "medium", 0.2),
    ("stability", "oxidation_risk", "high", 0.4),
    ("stability", "deamidation_risk", "medium", 0.2),
    ("stability", "deamidation_risk", "high", 0.4),
    ("synthesis_feasibility", "disulfide_category", "flag", 0.2),
    ("synthesis_feasibility", "disulfide_category", "high", 0.4),
]
MAX_DEDUCTION = 0.4
#: Distinct values whose places are sent to all tasks; more are joined by a shuffle.
SENT_VALUES = 100_000


def brief_points(briefs: DataFrame, links: tuple = (FUNCTION_LINKS, CONTEXT_LINKS, PATHOGEN_LINK)) -> DataFrame:
    """(brief_id, module, kind, points): what each entry of each brief (functions, contexts, pathogens: arrays) points to."""
    functions, contexts, (pathogen_module, pathogen_points) = links
    spark = briefs.sparkSession
    table = lambda rows: F.broadcast(spark.createDataFrame(rows, "entry string, module string, points double"))
    each = lambda c: briefs.select("brief_id", F.explode(F.array_distinct(c)).alias("entry"))
    named = each("functions").join(table(functions), "entry").select("brief_id", "module", F.lit("reference").alias("kind"), "points")
    implied = each("contexts").join(table(contexts), "entry").select("brief_id", "module", F.lit("implication").alias("kind"), "points")
    germs = briefs.where(F.size("pathogens") > 0).select("brief_id", F.lit(pathogen_module).alias("module"), F.lit("reference").alias("kind"), F.lit(pathogen_points).alias("points"))
    return named.unionByName(implied).unionByName(germs)


def objective_counts(briefs: DataFrame, modules: DataFrame) -> DataFrame:
    """(brief_id, module, n_k, requested): the best reference plus all implications; a brief that points nowhere counts each as 1."""
    points = brief_points(briefs).groupBy("brief_id", "module").agg(F.max(F.when(F.col("kind") == "reference", F.col("points"))).alias("ref"), F.sum(F.when(F.col("kind") == "implication", F.col("points")).otherwise(0.0)).alias("impl"))
    grid = briefs.select("brief_id").crossJoin(F.broadcast(modules.where("grp = 'objective'").select("module")))
    n = F.coalesce("ref", F.lit(0.0)) + F.coalesce("impl", F.lit(0.0))
    out = grid.join(points, ["brief_id", "module"], "left").select("brief_id", "module", n.alias("n"), F.col("ref").isNotNull().alias("requested"))
    whole = F.sum("n").over(Window.partitionBy("brief_id"))
    return out.select("brief_id", "module", F.when(whole == 0, 1.0).otherwise(F.col("n")).alias("n_k"), "requested")


def module_weights(counts: DataFrame, modules: DataFrame) -> DataFrame:
    """(brief_id, module, n_k, nominal_weight): always-on modules count as the objectives' average; weights sum to 1."""
    average = counts.groupBy("brief_id").agg(F.avg("n_k").alias("n_k"))
    always = average.crossJoin(F.broadcast(modules.where("grp = 'always_on'").select("module"))).select("brief_id", "module", "n_k")
    every = counts.select("brief_id", "module", "n_k").unionByName(always)
    return every.withColumn("nominal_weight", F.col("n_k") / F.sum("n_k").over(Window.partitionBy("brief_id")))


def deductions(have: list[str], numeric: list = NUMERIC_FLAGS, levels: list = LEVEL_FLAGS) -> dict[str, Column]:
    """What each module loses, from one column for each flag (of `have`): a numeric flag deducts (v - line) / (2 (limit - line))
    between 0 and MAX_DEDUCTION, the most of its bounds; a level deducts what it says; a missing value nothing."""
    per: dict[str, dict[str, list[Column]]] = {}
    for module, flag, line, limit, centre in numeric:
        if flag in have:
            value = F.col(flag).cast("double") if centre is None else F.abs(F.col(flag) - centre)
            # As decimals: 2 * (0.7 - 0.6) in doubles is not 0.2, and a last bit decides which of two equal scores dominates.
            width = float(2 * (Decimal(str(limit)) - Decimal(str(line))))
            cut = F.least(F.lit(MAX_DEDUCTION), F.greatest(F.lit(0.0), (value - line) / width))
            per.setdefault(module, {}).setdefault(flag, []).append(F.when(value.isNotNull(), cut).otherwise(0.0))
    for module, flag, level, loss in levels:
        if flag in have:
            per.setdefault(module, {}).setdefault(flag, []).append(F.when(F.col(flag) == level, loss).otherwise(0.0))
    best = lambda cs: F.greatest(*cs) if len(cs) > 1 else cs[0]
    return {m: F.least(F.lit(1.0), sum((best(cs) for cs in fs.values()), F.lit(0.0))) for m, fs in per.items()}


def flag_deductions(flags: DataFrame) -> DataFrame:
    """(id, module, deduction): only modules that lose anything."""
    totals = F.array(*(F.struct(F.lit(m).alias("module"), c.alias("deduction")) for m, c in deductions(flags.columns).items()))
    return flags.select("id", F.explode(F.filter(totals, lambda x: x["deduction"] > 0)).alias("x")).select("id", "x.module", "x.deduction")


def combined(scores: DataFrame) -> DataFrame:
    """One row per id of (id, module, score after deductions, nominal_weight): final_score, evidence_coverage, status, stability.

    Modules of weight 0 are not activated. Weights are renormalised over the modules that have a score; none: insufficient_evidence.
    """
    on = scores.where("nominal_weight > 0")
    per = on.groupBy("id").agg(
        F.sum(F.when(F.col("score").isNotNull(), F.col("nominal_weight") * F.col("score"))).alias("sum"),
        F.sum(F.when(F.col("score").isNotNull(), F.col("nominal_weight"))).alias("weight"),
        (F.count("score") / F.count(F.lit(1))).alias("evidence_coverage"),
        F.max(F.when(F.col("module") == "stability", F.col("score"))).alias("stability"),
    )
    final = F.round(F.least(F.lit(1.0), F.col("sum") / F.col("weight")), 9)
    return per.select("id", final.alias("final_score"), F.round("evidence_coverage", 9).alias("evidence_coverage"), F.when(F.col("weight") > 0, "ranked").otherwise("insufficient_evidence").alias("status"), "stability")


def deducted(flags: Mapping[str, np.ndarray], numeric: list = NUMERIC_FLAGS, levels: list = LEVEL_FLAGS) -> dict[str, np.ndarray]:
    """`deductions` for the flags of a batch (numeric ones as floats, NaN: missing; levels as strings), term by term the same."""
    per: dict[str, dict[str, np.ndarray]] = {}
    for module, flag, line, limit, centre in numeric:
        if flag in flags:
            value = flags[flag] if centre is None else np.abs(flags[flag] - centre)
            width = float(2 * (Decimal(str(limit)) - Decimal(str(line))))
            cut = np.where(np.isnan(value), 0.0, np.clip((value - line) / width, 0.0, MAX_DEDUCTION))
            per.setdefault(module, {})[flag] = np.maximum(per.get(module, {}).get(flag, 0.0), cut)
    for module, flag, level, loss in levels:
        if flag in flags:
            per.setdefault(module, {})[flag] = np.maximum(per.get(module, {}).get(flag, 0.0), np.where(flags[flag] == level, loss, 0.0))
    return {m: np.minimum(1.0, sum(fs.values(), 0.0)) for m, fs in per.items()}


def combined_batch(scores: Mapping[str, np.ndarray], weights: Mapping[str, float]) -> dict[str, np.ndarray]:
    """The columns of `combined` for a batch, from the deducted scores (NaN: none) of each module of the brief: the same arithmetic without
    a row for each module, so nothing is shuffled. tie is the stability that breaks ties, -1 without one; the status follows from
    final_score, which only candidates without evidence lack."""
    weighed, weight, have = 0.0, 0.0, 0
    for m, s in scores.items():
        has = ~np.isnan(s)
        weighed, weight, have = weighed + np.where(has, weights[m] * s, 0.0), weight + np.where(has, weights[m], 0.0), have + has
    with np.errstate(divide="ignore", invalid="ignore"):
        final = np.where(weight > 0, decimals(np.minimum(1.0, weighed / weight), 9), np.nan)
    stable = decimals(scores["stability"], 9) if "stability" in scores else np.full(len(final), np.nan)
    return {"final_score": final, "evidence_coverage": decimals(have / len(scores), 9), "tie": np.where(np.isnan(stable), -1.0, stable)}


def in_order(df: DataFrame, order: list[Column], stage: Callable[[DataFrame, str], DataFrame], weight: str | None = None, written: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in `keep`) with _before: the rows (or the sum of `weight`) that stand before each row in the order.

    Ranges of the order are sorted by all tasks. A row's place is its place in its range plus what the ranges before it hold: one
    number for each range. Rows are written twice (once if df is written already), so that neither the order's bounds nor a lost task can
    move a row between ranges. The order should name columns: comparisons compute an expression anew each time.
    """
    rows = df if written else stage(df, "unordered")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed if keep is None else placed.select(*keep, "_at")
    placed = stage(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    n = F.lit(1) if weight is None else F.col(weight)
    parts = placed.groupBy("_part").agg(F.sum(n).alias("_n"))
    # A row for each range.
    above = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_above"))
    inside = F.col("_at") if weight is None else F.sum(weight).over(Window.partitionBy("_part").orderBy("_at")) - F.col(weight)
    return placed.withColumn("_inside", inside).join(F.broadcast(above), "_part").withColumn("_before", F.col("_above") + F.col("_inside")).drop("_part", "_at", "_above", "_inside")


def global_rank(df: DataFrame, score: str, ties: list[Column], stage: Callable[[DataFrame, str], DataFrame], written: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in `keep`) with rank: position from 1 by falling score, then ties. No task sees more than a range of the order, however scores lie."""
    return in_order(df, [F.desc(score), *ties], stage, written=written, keep=keep).withColumn("rank", (F.col("_before") + 1).cast("long")).drop("_before")


def avg_rank_percentile(df: DataFrame, value: str, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """df with percentile: 1 for the best, 0 for the worst, ties share their mean place, 0.5 alone; null without a value.

    Counted over distinct values, so rows that tie never meet in one task. Up to SENT_VALUES of them are counted and broadcast: a shuffle
    would bring all rows that tie, and all without a value, together after all.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    below = in_order(sizes, [F.col(value)], stage, "_n")
    whole = below.agg(F.max(F.col("_before") + F.col("_n")).alias("_all"))
    share = (F.col("_before") + (F.col("_n") - 1) / 2) / (F.col("_all") - 1)
    place = below.crossJoin(F.broadcast(whole)).select(value, F.when(F.col("_all") < 2, 0.5).otherwise(share).alias("percentile"))
    return df.join(F.broadcast(place) if below.count() <= SENT_VALUES else place, value, "left")
