"""Per-case metrics, per-lesion tables and summaries.

Metric names and the split into averaged and summed ones are fixed values of the
metric set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.functions import ratios
from voxelweave.operators import overlap

CLU_AVERAGED = ["F1_CLU", "Recall_CLU", "Precision_CLU", "Dice_Per_TP_CLU", "PQ_CLU"]
CLU_SUMMED = ["CLU_Count", "TP_CLU", "FN_CLU"]
VARIANTS = {(0, 6): "", (1, 6): "_tier_1", (0, 26): "_conn_26", (1, 26): "_tier_1_conn_26"}

AVERAGED = ["PQ", "DSC", "nDSC", "F1", "Recall", "Precision", "FPR", "Dice_Per_TP", "DiC"] + [
    f"{m}{suffix}" for suffix in VARIANTS.values() for m in CLU_AVERAGED
]
SUMMED = ["TP", "FP", "FN", "Pred_Lesion_Count", "Ref_Lesion_Count", "FP_CLU"] + [
    f"{m}{suffix}" for suffix in VARIANTS.values() for m in CLU_SUMMED
]

COUNTS = ["inter", "n_pred", "n_ref", "n_pred_inst", "n_ref_inst"]


def case_counts(table: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Voxel and instance counts per case from a contingency table."""
    on_pred, on_ref = F.col("pred_id") > 0, F.col("ref_id") > 0
    voxel_sums = table.groupBy(*keys).agg(
        F.sum(F.when(on_pred & on_ref, F.col("n")).otherwise(0)).alias("inter"),
        F.sum(F.when(on_pred, F.col("n")).otherwise(0)).alias("n_pred"),
        F.sum(F.when(on_ref, F.col("n")).otherwise(0)).alias("n_ref"),
    )
    # Distinct ids by two-step grouping, so that a large case is counted by many tasks.
    sides = table.withColumn("s", F.explode(F.array(
        F.struct(F.lit("p").alias("side"), F.col("pred_id").alias("id")),
        F.struct(F.lit("r").alias("side"), F.col("ref_id").alias("id")),
    ))).filter("s.id > 0")
    ids = sides.select(*keys, "s.side", "s.id").distinct()
    inst = ids.groupBy(*keys).agg(
        F.sum(F.when(F.col("side") == "p", 1).otherwise(0)).alias("n_pred_inst"),
        F.sum(F.when(F.col("side") == "r", 1).otherwise(0)).alias("n_ref_inst"),
    )
    return voxel_sums.join(inst, list(keys), "left")


def match_counts(matches: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    kept = F.col("kept")
    return matches.groupBy(*keys).agg(
        F.sum(F.when(kept, 1).otherwise(0)).alias("TP"),
        F.sum(F.when(kept, 0).otherwise(1)).alias("FP_CLU"),
        F.sum(F.when(kept, F.col("iou"))).alias("sum_iou"),
        F.avg(F.when(kept, F.col("dice"))).alias("mean_dice"),
    )


def case_table(cases: DataFrame, table: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per case, empty cases included, with every count the metrics need."""
    wide = (
        cases.select("case_id", (F.col("nx") * F.col("ny") * F.col("nz")).alias("n_all"))
        .join(case_counts(table), "case_id", "left")
        .join(match_counts(matches), "case_id", "left")
    )
    zero = F.lit(0).cast("long")
    filled = wide.withColumns({c: F.coalesce(c, zero) for c in [*COUNTS, "TP", "FP_CLU"]})
    return filled.withColumns(
        {
            "sum_iou": F.coalesce("sum_iou", F.lit(0.0)),
            "FP": F.col("n_pred_inst") - F.col("TP"),
            "FN": F.col("n_ref_inst") - F.col("TP"),
        }
    )


# Name -> expression over a row of case_table. Users may register more.
EXPRESSIONS = {
    "DSC": lambda: ratios.dice("inter", "n_pred", "n_ref"),
    "nDSC": lambda: ratios.normalised_dice("inter", "n_pred", "n_ref", "n_all"),
    "Dice_Per_TP": lambda: F.coalesce("mean_dice", F.lit(0.0)),
    "PQ": lambda: ratios.panoptic_quality("sum_iou", "TP", "FP", "FN", "n_pred_inst", "n_ref_inst"),
    "F1": lambda: ratios.f_beta("TP", "FP", "FN"),
    "Recall": lambda: ratios.hit_rate("TP", "FN"),
    "Precision": lambda: ratios.hit_rate("TP", "FP"),
    "FPR": lambda: ratios.dbl("FP") / (ratios.dbl("n_pred_inst") + ratios.EPS),
    "DiC": lambda: F.abs(F.col("n_pred_inst") - F.col("n_ref_inst")).cast("double"),
    "Pred_Lesion_Count": lambda: F.col("n_pred_inst"),
    "Ref_Lesion_Count": lambda: F.col("n_ref_inst"),
}


def register_metric(name: str, expression) -> None:
    """Adds a metric: a function that returns a Column over the case table."""
    EXPRESSIONS[name] = expression


def score(counts: DataFrame, names: list[str] | None = None) -> DataFrame:
    chosen = {n: EXPRESSIONS[n]() for n in (names or EXPRESSIONS)}
    return counts.withColumns(chosen)


def count_violations(counts: DataFrame) -> DataFrame:
    """Cases that break n_ref = TP + FN or n_pred = TP + FP, or where TP exceeds either."""
    return counts.filter(
        (F.col("TP") + F.col("FN") != F.col("n_ref_inst"))
        | (F.col("TP") + F.col("FP") != F.col("n_pred_inst"))
        | (F.least("FP", "FN") < 0)
    )


def clu_matches(pairs: DataFrame, confluent: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Re-matches against the confluent refs of every variant at once."""
    keys = ("case_id", "tier", "conn")
    limited = pairs.join(confluent.select("case_id", "tier", "conn", "ref_id"), ["case_id", "ref_id"])
    return overlap.best_pred_per_ref(overlap.best_ref_per_pred(limited, threshold, keys), keys)


def clu_metrics(counts: DataFrame, pairs: DataFrame, confluent: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The confluent-unit metrics, one row per (case, tier, conn).

    ``FP_CLU`` is the number of removed matches of the global matching for every
    variant, also inside PQ_CLU.
    """
    keys = ["case_id", "tier", "conn"]
    variants = F.array(*[
        F.struct(F.lit(t).cast("long").alias("tier"), F.lit(c).cast("long").alias("conn")) for t, c in VARIANTS
    ])
    base = counts.select("case_id", "FP_CLU", "n_pred_inst", F.explode(variants).alias("v")).select(
        "case_id", "v.tier", "v.conn", "FP_CLU", "n_pred_inst"
    )
    n_cl = confluent.groupBy(*keys).agg(F.count("*").alias("CLU_Count"))
    matched = match_counts(clu_matches(pairs, confluent, threshold), tuple(keys)).drop("FP_CLU")
    wide = base.join(n_cl, keys, "left").join(matched, keys, "left")
    zero = F.lit(0).cast("long")
    wide = wide.withColumns(
        {"CLU_Count": F.coalesce("CLU_Count", zero), "TP_CLU": F.coalesce("TP", zero),
         "sum_iou": F.coalesce("sum_iou", F.lit(0.0))}
    ).withColumn("FN_CLU", F.col("CLU_Count") - F.col("TP_CLU"))
    none = F.col("CLU_Count") == 0
    tp, fp = ratios.dbl("TP_CLU"), ratios.dbl("FP_CLU")
    wide = wide.withColumns(
        {
            "Recall_CLU": ratios.hit_rate("TP_CLU", "FN_CLU"),
            "Dice_Per_TP_CLU": F.when(~none, F.coalesce("mean_dice", F.lit(0.0))),
            "Precision_CLU": F.when(none & (F.col("FP_CLU") == 0), 1.0).otherwise(tp / (tp + fp + ratios.EPS)),
            "PQ_CLU": ratios.panoptic_quality("sum_iou", "TP_CLU", "FP_CLU", "FN_CLU", "n_pred_inst", "CLU_Count"),
        }
    )
    p, r = F.col("Precision_CLU"), F.col("Recall_CLU")
    wide = wide.withColumn("F1_CLU", 2.0 * (r * p) / (r + p + ratios.EPS))
    return wide.select(*keys, *CLU_SUMMED, *CLU_AVERAGED)


def clu_wide(clu: DataFrame) -> DataFrame:
    """One row per case; the variants become column suffixes."""
    names = [*CLU_SUMMED, *CLU_AVERAGED]
    columns = []
    for (tier, conn), suffix in VARIANTS.items():
        here = (F.col("tier") == tier) & (F.col("conn") == conn)
        columns += [F.max(F.when(here, F.col(m))).alias(f"{m}{suffix}") for m in names]
    return clu.groupBy("case_id").agg(*columns)


def confluence_flags(confluent: DataFrame) -> DataFrame:
    """Per reference instance: one boolean per variant."""
    columns = []
    for (tier, conn), suffix in VARIANTS.items():
        here = (F.col("tier") == tier) & (F.col("conn") == conn)
        columns.append(F.max(here).alias(f"is_confluent{suffix}"))
    return confluent.groupBy("case_id", "ref_id").agg(*columns)


def pred_matches(table: DataFrame, matches: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per predicted instance; NULL where it has no kept match."""
    kept = matches.filter("kept").select("case_id", "pred_id", "ref_id", "n_ref", "dice", "iou")
    spaced = (
        overlap.instances(table, "pred_id").select("case_id", "pred_id", "n")
        .join(kept, ["case_id", "pred_id"], "left")
        .join(cases.select("case_id", "sx", "sy", "sz"), "case_id")
    )
    return spaced.select(
        F.col("case_id").alias("patient_id"), F.col("pred_id").alias("pred_lesion_id"),
        F.col("ref_id").alias("Ref_Lesion_ID_Match"),
        ratios.volume_mm3("n").alias("Volume_Pred"), ratios.volume_mm3("n_ref").alias("Volume_Ref"),
        F.col("dice").alias("DSC"), F.col("iou").alias("IoU"),
        F.col("ref_id").isNotNull().alias("TP"), F.col("ref_id").isNull().alias("FP"),
    )


def ref_matches(table: DataFrame, matches: DataFrame, cases: DataFrame, confluent: DataFrame) -> DataFrame:
    """One row per reference instance, with its confluence flags."""
    kept = matches.filter("kept").select("case_id", "pred_id", "ref_id", "n_pred", "dice", "iou")
    spaced = (
        overlap.instances(table, "ref_id").select("case_id", "ref_id", "n")
        .join(kept, ["case_id", "ref_id"], "left")
        .join(confluence_flags(confluent), ["case_id", "ref_id"], "left")
        .join(cases.select("case_id", "sx", "sy", "sz"), "case_id")
    )
    flags = [f"is_confluent{s}" for s in VARIANTS.values()]
    return spaced.select(
        F.col("case_id").alias("patient_id"), F.col("ref_id").alias("ref_lesion_id"),
        F.col("pred_id").alias("Pred_Lesion_ID_Match"),
        ratios.volume_mm3("n").alias("Volume_Ref"), ratios.volume_mm3("n_pred").alias("Volume_Pred"),
        F.col("dice").alias("DSC"), F.col("iou").alias("IoU"),
        *[F.coalesce(f, F.lit(False)).alias(f) for f in flags],
        F.col("pred_id").isNull().alias("FN"),
    )


def summarise(metrics: DataFrame, keys: list[str], averaged: list[str] | None = None,
              summed: list[str] | None = None, cube: bool = False) -> DataFrame:
    """Means and sums over cases; a value that does not apply (NULL) is skipped."""
    averaged = AVERAGED if averaged is None else averaged
    summed = SUMMED if summed is None else summed
    grouped = metrics.cube(*keys) if cube else metrics.groupBy(*keys)
    return grouped.agg(*[F.avg(m).alias(m) for m in averaged], *[F.sum(m).alias(m) for m in summed])


def across_folds(fold_summaries: DataFrame, keys: list[str], averaged: list[str] | None = None,
                 summed: list[str] | None = None) -> DataFrame:
    """Mean, sum and population deviation over folds; a missing fold value makes the result NULL."""
    averaged = AVERAGED if averaged is None else averaged
    summed = SUMMED if summed is None else summed
    full = lambda m: F.count(m) == F.count(F.lit(1))
    return fold_summaries.groupBy(*keys).agg(
        *[F.when(full(m), F.avg(m)).alias(m) for m in averaged],
        *[F.when(full(m), F.sum(m)).alias(m) for m in summed],
        *[F.when(full(m), F.stddev_pop(m)).alias(f"{m}_std") for m in averaged],
    )
