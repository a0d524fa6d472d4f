"""Step audits (A14): the counts the reference prints, as tables.

``stage01_audit`` computes every count of the preparation stage in one
aggregation over the raw table (no ``count()`` per step). ``StepLog``
attaches counts to the passes of stages 02-05 with ``DataFrame.observe``, so
the written stages report dropped, filled and capped rows with no extra job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions.text import as_number
from noticeflow.operators.consolidate import DISCONTINUED, UNSUCCESSFUL
from noticeflow.operators.reduce import xsd_ok


def _ok(df: DataFrame, c: str):
    return F.coalesce(F.col(c) == 0, F.lit(False)) if c in df.columns else F.lit(True)


def stage01_audit(raw: DataFrame, dataset: str) -> DataFrame:
    """(Dataset, Step, Rows): rows left after each filter of stage 01, and
    the valid/filled counts of the consolidation steps."""
    s1 = xsd_ok(raw)
    s2 = s1 & _ok(raw, "CANCELLED")
    s3 = s2 & _ok(raw, "OUT_OF_DIRECTIVES")
    steps = [("input", F.lit(True)), ("after_xsd_version", s1), ("after_cancelled", s2),
             ("after_out_of_directives", s3)]
    last = s3
    if "INFO_ON_NON_AWARD" in raw.columns:
        last = s3 & ~F.col("INFO_ON_NON_AWARD").eqNullSafe(DISCONTINUED)
        steps.append(("after_discontinued", last))
    val = F.coalesce(*[F.col(c) for c in ("VALUE_EURO_FIN_2", "VALUE_EURO_FIN_1", "VALUE_EURO")
                       if c in raw.columns])
    steps.append(("total_value_valid", last & val.isNotNull()))
    if "NUMBER_TENDERS_SME" in raw.columns:
        nums = [as_number(F.col(c))
                for c in ("NUMBER_TENDERS_SME", "NUMBER_TENDERS_OTHER_EU", "NUMBER_TENDERS_NON_EU")
                if c in raw.columns]
        has = F.coalesce(*nums).isNotNull()
        filled = (F.col("INFO_ON_NON_AWARD") == UNSUCCESSFUL) & ~has
        steps.append(("tenders_filled_zero", last & F.coalesce(filled, F.lit(False))))
        steps.append(("tenders_valid", last & (has | F.coalesce(filled, F.lit(False)))))
    a = raw.agg(*[F.sum(e.cast("int")).cast("bigint").alias(f"_{i}") for i, (_, e) in enumerate(steps)])
    arr = F.array(*[F.struct(F.lit(dataset).alias("Dataset"), F.lit(n).alias("Step"),
                             F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("bigint").alias("Rows"))
                    for i, (n, _) in enumerate(steps)])
    return a.select(F.inline(arr))


class StepLog:
    """Counts of pipeline steps, observed by the passes that run anyway.

    ``watch`` marks a table on its way: when some action has read it whole (a
    written stage, a fence), its row count and the given conditions' counts are
    known, without a job of their own. ``table`` is read after the last write."""

    def __init__(self):
        self.entries: list[tuple[str, str, list[str], Observation]] = []

    def watch(self, df: DataFrame, stage: str, step: str, **counts: Column) -> DataFrame:
        obs = Observation(f"{stage}-{step}-{uuid.uuid4().hex}")
        self.entries.append((stage, step, list(counts), obs))
        return df.observe(obs, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in counts.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        """(Stage, Step, Measure, Count): ``rows`` of every step, then its conditions."""
        rows = []
        for stage, step, names, obs in self.entries:
            got = obs.get
            rows += [(stage, step, name, int(got[name])) for name in ["rows", *names]]
        return spark.createDataFrame(rows, "Stage string, Step string, Measure string, Count bigint")
