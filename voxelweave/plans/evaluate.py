"""Evaluation of predicted against reference instances, all cases in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import bricks, integrity, metrics, overlap, sizes
from voxelweave.operators.confluence import confluent_instances
from voxelweave.operators.overlap import COORDS
from voxelweave.operators.ranking import rank_in_group
from voxelweave.session import materialize, shuffled


@dataclass
class Evaluation:
    """Results of one evaluation; they read the small tables that :func:`evaluate` has written."""

    metrics: DataFrame
    pred_matches: DataFrame
    ref_matches: DataFrame
    matches: DataFrame
    contingency: DataFrame


def evaluate(voxels: DataFrame, cases: DataFrame, min_volume: float = 14, min_axis: float = 3,
             threshold: float = 0.1, side: int = bricks.SIDE) -> Evaluation:
    """Removes too-small references, matches, and scores every case.

    The voxels are read twice: once for the contingency table, once for the
    confluence of the references. Both results are instance-sized and are written
    down, so that the many metrics that read them do not repeat the passes. Voxels
    without a case row or outside their grid raise an error.
    """
    raw = materialize(overlap.contingency(voxels), "contingency")
    integrity.require_grid(raw, cases)
    table = materialize(sizes.drop_small(raw, cases, "ref_id", min_volume, min_axis), "contingency")
    kept_refs = table.filter("ref_id > 0").select("case_id", "ref_id").distinct()
    refs = voxels.filter("ref_id > 0").join(kept_refs, ["case_id", "ref_id"], "left_semi")
    confluent = materialize(confluent_instances(refs, cases, tuple(metrics.VARIANTS), side), "confluent")
    return _scored(table, cases, confluent, threshold)


def _scored(table: DataFrame, cases: DataFrame, confluent: DataFrame, threshold: float) -> Evaluation:
    """Metrics and lesion tables from the written contingency table and the confluent references."""
    pairs = materialize(overlap.overlap_pairs(table), "pairs")
    matches = materialize(overlap.best_pred_per_ref(overlap.best_ref_per_pred(pairs, threshold)), "matches")
    counts = metrics.case_table(cases, table, matches)
    scored = metrics.score(counts)
    clu = metrics.clu_wide(metrics.clu_metrics(counts, pairs, confluent, threshold))
    wide = scored.join(clu, "case_id").select("case_id", *metrics.AVERAGED, *metrics.SUMMED)
    return Evaluation(
        metrics=wide,
        pred_matches=metrics.pred_matches(table, matches, cases),
        ref_matches=metrics.ref_matches(table, matches, cases, confluent),
        matches=matches,
        contingency=table,
    )


def evaluate_variants(predictions: DataFrame, references: DataFrame, cases: DataFrame, by: tuple[str, ...] = ("model", "postprocessor"),
                      min_volume: float = 14, min_axis: float = 3, threshold: float = 0.1, side: int = bricks.SIDE) -> Evaluation:
    """Evaluates the predictions of several models and post-processors against the same references.

    ``predictions`` holds case_id, x, y, z, pred_id and the columns ``by``;
    ``references`` every reference voxel once. Sizes, the removal of too-small
    references and their confluence are worked out once; the predicted voxels of
    all variants meet the references in one join, and what no prediction met
    follows from the sizes. So neither the scans of the references nor the brick
    passes depend on the number of variants. Every case is scored for every variant
    that ``predictions`` names, also where a variant has no voxel of it (a row
    whose pred_id is 0 or NULL names a variant). The results carry ``by``. Inside,
    a variant's case is a case of its own with a number of its own.
    """
    refs = references.filter("ref_id > 0").select("case_id", *COORDS, "ref_id")
    inst = materialize(refs.groupBy("case_id", "ref_id").agg(F.count("*").alias("n"), *overlap.bounds()), "references")
    integrity.require_grid(inst, cases)
    small = sizes.size_verdicts(inst, cases, min_volume, min_axis).filter("too_small").select("case_id", "ref_id")
    kept = materialize(inst.join(small, ["case_id", "ref_id"], "left_anti"), "kept-references")
    whole = refs.join(kept.select("case_id", "ref_id"), ["case_id", "ref_id"], "left_semi")
    confluent = materialize(confluent_instances(whole, cases, tuple(metrics.VARIANTS), side), "confluent")

    names = predictions.select(*by).distinct()
    numbered = rank_in_group(names, [], [F.col(c) for c in by], [F.lit(0)], "__variant")
    numbered = materialize(numbered.withColumn("__variant", F.col("__variant") - 1), "variants")
    total = max(numbered.count(), 1)
    places = rank_in_group(cases.select("case_id"), [], [F.col("case_id")], [F.floor(F.col("case_id") / 4096)], "__no")
    places = materialize(places, "case-numbers")
    own = (F.col("__no") * total + F.col("__variant")).alias("case_id")

    zero, keys = F.lit(0).cast("long"), [*by, "case_id"]
    met = predictions.filter("pred_id > 0").select(*keys, *COORDS, "pred_id").join(shuffled(refs), ["case_id", *COORDS], "left")
    met = overlap.contingency(met.withColumn("ref_id", F.coalesce("ref_id", zero)), tuple(keys))
    met = materialize(met, "met")
    integrity.require_grid(met, cases)
    # Too-small references count as background from here on.
    met = met.join(kept.select("case_id", "ref_id", F.lit(True).alias("__kept")), ["case_id", "ref_id"], "left")
    met = met.withColumn("ref_id", F.when(F.col("__kept"), F.col("ref_id")).otherwise(zero))
    met = met.groupBy(*keys, "pred_id", "ref_id").agg(F.sum("n").alias("n"), *overlap.merged_bounds())
    same = [F.col(c).eqNullSafe(F.col(f"__v_{c}")) for c in by]
    renamed = numbered.select("__variant", *[F.col(c).alias(f"__v_{c}") for c in by])
    found = ["pred_id", "ref_id", "n", *[f"{end}_{a}" for a in COORDS for end in ("lo", "hi")]]
    met = materialize(met.join(renamed, same).join(places, "case_id").select("__no", "__variant", *found), "met-numbered")

    every = F.explode(F.sequence(zero, F.lit(total - 1).cast("long"))).alias("__variant")
    rest = kept.join(places, "case_id").select("*", every)
    covered = met.filter("ref_id > 0").groupBy("__no", "__variant", "ref_id").agg(F.sum("n").alias("__met"))
    rest = rest.join(covered, ["__no", "__variant", "ref_id"], "left").withColumns(
        {"n": F.col("n") - F.coalesce("__met", zero), "pred_id": zero})
    # The remainder carries the box of its whole reference.
    table = materialize(met.unionByName(rest.select("__no", "__variant", *found)).select(own, *found), "contingency")
    each = cases.join(places, "case_id").select("*", every).select(own, *[F.col(c) for c in cases.columns if c != "case_id"])
    shared = confluent.join(places, "case_id").select("*", every).select(own, "tier", "conn", "ref_id")
    result = _scored(table, materialize(each, "variant-cases"), materialize(shared, "variant-confluent"), threshold)

    def named(df: DataFrame, key: str = "case_id") -> DataFrame:
        split = df.withColumns({"__variant": F.pmod(F.col(key), F.lit(total)), "__no": F.expr(f"{key} div {total}")}).drop(key)
        back = split.join(places.withColumnRenamed("case_id", key), "__no").join(numbered, "__variant")
        return back.select(*by, *df.columns)

    return Evaluation(
        metrics=named(result.metrics), pred_matches=named(result.pred_matches, "patient_id"),
        ref_matches=named(result.ref_matches, "patient_id"), matches=named(result.matches), contingency=named(result.contingency),
    )


def semantic_scores(table: DataFrame, cases: DataFrame) -> DataFrame:
    """The tracked validation metrics (DSC, nDSC, PQ) per case from a contingency table."""
    matches = overlap.match(table)
    return metrics.score(metrics.case_table(cases, table, matches), ["DSC", "nDSC", "PQ"]).select(
        "case_id", "DSC", "nDSC", "PQ"
    )


def evaluate_model(voxels: DataFrame, cases: DataFrame, keys: tuple[str, ...] = ("fold",), **options) -> tuple[DataFrame, DataFrame]:
    """Fold summaries and the summary across folds of one model's predictions."""
    result = evaluate(voxels, cases, **options).metrics
    tagged = materialize(result.join(cases.select("case_id", *keys), "case_id"), "case-metrics")
    folds = metrics.summarise(tagged, list(keys))
    outer = [k for k in keys if k != "fold"]
    return folds, metrics.across_folds(folds, outer)


def postprocessors_for(models: DataFrame, instance_name: str = "OFFSETS") -> DataFrame:
    """The post-processors whose output is evaluated: semantic models have two, others one."""
    semantic = F.array(F.lit("ACLS"), F.lit("CC"))
    chosen = F.when(F.contains(F.col("model"), F.lit("SEMANTIC")), semantic).otherwise(F.array(F.lit(instance_name)))
    return models.withColumn("postprocessor", F.explode(chosen))
