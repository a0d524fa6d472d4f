"""Stages 01 -> 05 chained: raw notices to the cleaned golden table.

Each stage is lazy. ``run_pipeline`` writes every stage to its own folder
(never overwriting its own input, which would delete the data before it is
read) so stages restart from the last written table and lineage stays
short; ``audited_stages`` counts what each step does while they are written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.operators import clean, match, merge
from noticeflow.operators.audit import StepLog
from noticeflow.operators.reduce import drop_missing_targets, remove_logical_errors
from noticeflow.plans.prepare import prepare
from noticeflow.session import materialize
from noticeflow.sources import fixtures


@dataclass
class Prepared:
    cfc: DataFrame
    can: DataFrame


def prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    """Stage 01 over the fixtures (the lazy plans are reused per session)."""
    return Prepared(
        fixtures.memo(spark, ("prep_cfc", sf_dir), lambda: prepare(fixtures.cfc(spark, sf_dir), "cfc")),
        fixtures.memo(spark, ("prep_can", sf_dir), lambda: prepare(fixtures.can(spark, sf_dir), "can")))


def notice_matched(p: Prepared) -> Prepared:
    """Stage 02: keep rows whose notice id occurs on both sides."""
    return Prepared(*match.split_by_notice(p.cfc, p.can).finalize())


def lot_matched(p: Prepared) -> Prepared:
    """Stage 03: keep rows whose (notice, lot) occurs on both sides."""
    return Prepared(*match.split_by_lot(p.cfc, p.can).finalize())


def written(p: Prepared) -> Prepared:
    """Both tables as Parquet, for several readers."""
    return Prepared(materialize(p.cfc), materialize(p.can))


def matched_raw(spark: SparkSession, sf_dir: str) -> Prepared:
    """Stages 01 to 03 as one lazy plan per side, the rows that ``lot_matched`` keeps.

    Matching reads ids only, which stage 01 takes over as they are. So both levels are
    matched on the prepared rows' ids, and whole rows are read and prepared once they are
    known to stay: lines meet the ids before they meet parts and orders."""
    p = prepared(spark, sf_dir)
    keys = [match.CFC_NOTICE, "ID_LOT"], [match.CAN_NOTICE, "ID_LOT"]
    ids = written(Prepared(p.cfc.select(*keys[0]), p.can.select(*keys[1])))
    ids = written(lot_matched(written(notice_matched(ids))))
    within = lambda k, names: lambda lines: match.with_ids(lines, k.select(F.col(names[0]).alias("_notice"), "ID_LOT"), ["_notice", "ID_LOT"])
    return Prepared(prepare(fixtures.cfc_of(spark, sf_dir, within(ids.cfc, keys[0])), "cfc"),
                    prepare(fixtures.can_of(spark, sf_dir, within(ids.can, keys[1])), "can"))


def master(p: Prepared) -> DataFrame:
    """Stage 04 join."""
    return merge.perform_master_merge(p.cfc, p.can)


def combined(p: Prepared) -> DataFrame:
    """Stage 04: the golden table (``ted_combined``)."""
    return materialize(merge.prepare_final_ml_dataset(master(p)))


def cleaned(ml: DataFrame, quantile_method: str = "ranked", log: StepLog | None = None) -> DataFrame:
    """Stage 05: targets present, logical errors, imputation, trimming,
    winsorising, in the reference's order (the order changes the fences)."""
    def seen(df: DataFrame, step: str, counts: dict | None = None) -> DataFrame:
        return df if log is None else log.watch(df, "05", step, **(counts or {}))

    df = seen(drop_missing_targets(ml, clean.CRITICAL_TARGETS), "targets_present")
    df = remove_logical_errors(df, clean.LOGICAL_CHECK_COLS, 0.0)
    df = seen(df, "logical_errors_removed", {f"missing_{c}": F.col(c).isNull() for c in ("B_EU_FUNDS", "B_RECURRENT_PROCUREMENT", "CRIT_CODE", "TOP_TYPE")})
    # each step's input feeds both its fences and its rows: materialise once
    # (the mode reads one column of the golden table; counts need a single pass over the step)
    df = materialize(clean.impute_domain_specific_missing_values(df if log is None else materialize(df)))
    df = clean.remove_extreme_outliers(df, clean.TARGET_LOG_COLS, 3.0, "log", quantile_method)
    df = materialize(seen(df, "outliers_removed"))
    for columns, method in ((clean.INPUT_LOG_COLS, "log"), (clean.INPUT_STANDARD_COLS, "standard")):
        df = clean.winsorize_features(df, columns, 3.0, method, quantile_method, watch=lambda j, counts, m=method: seen(j, f"capped_{m}", counts))
        if method == "log":
            df = materialize(df)
    return df


def audited_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 for stages 02-05: what each step kept, filled and capped, counted by the writes of the stages."""
    log = StepLog()

    def both(p: Prepared, stage: str) -> Prepared:
        return Prepared(materialize(log.watch(p.cfc, stage, "cfc")), materialize(log.watch(p.can, stage, "can")))

    p = both(prepared(spark, sf_dir), "01")
    p = both(notice_matched(p), "02")
    p = both(lot_matched(p), "03")
    ml = materialize(log.watch(merge.prepare_final_ml_dataset(master(p)), "04", "merged"))
    materialize(cleaned(ml, log=log))
    return log.table(spark)


def _stage(spark: SparkSession, name: str, sf_dir: str, build) -> Prepared:
    return fixtures.memo(spark, (name, sf_dir), lambda: written(build()))


def stage01(spark: SparkSession, sf_dir: str) -> Prepared:
    """Stage 01 tables, written once per session (reliable checkpoint)."""
    return _stage(spark, "stage01", sf_dir, lambda: prepared(spark, sf_dir))


def stage02(spark: SparkSession, sf_dir: str) -> Prepared:
    """Stage 02 (notice-matched) tables, written once per session."""
    return _stage(spark, "stage02", sf_dir, lambda: notice_matched(stage01(spark, sf_dir)))


def stage03(spark: SparkSession, sf_dir: str) -> Prepared:
    """Stage 03 (lot-matched) tables, written once per session."""
    return _stage(spark, "stage03", sf_dir, lambda: lot_matched(stage02(spark, sf_dir)))


def run_pipeline(spark: SparkSession, sf_dir: str, out_root: str) -> dict[str, str]:
    """Write every stage to ``out_root/<stage>`` and read it back for the next.

    ``out_root`` must be a shared folder on a cluster (for example under
    ``spark.checkpoint.dir``); each stage is a separate directory.
    """
    paths = {}

    def write(df: DataFrame, name: str) -> DataFrame:
        path = f"{out_root.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        paths[name] = path
        return spark.read.parquet(path)

    p = prepared(spark, sf_dir)
    p = Prepared(write(p.cfc, "prepared_cfc"), write(p.can, "prepared_can"))
    p = notice_matched(p)
    p = Prepared(write(p.cfc, "notice_cfc"), write(p.can, "notice_can"))
    p = lot_matched(p)
    p = Prepared(write(p.cfc, "lot_cfc"), write(p.can, "lot_can"))
    ml = write(combined(p), "ted_combined")
    write(cleaned(ml), "ted_prepared")
    return paths
