"""Row counts of the stages of a job, taken while the job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageCounts:
    """Counts the rows that pass the named stages of one job, in that job's own pass.

    Hand it to a plan that takes ``counts``, run the result once, then read the counts.
    No stage is computed for the sake of its count, and texts are read once. The counts
    are those of the first run only, and of a run without failures: what a lost executor
    had counted is counted again where it is computed again.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def of(self, stage: str, df: DataFrame) -> DataFrame:
        """``df``, whose rows are counted under the name ``stage`` when it is run."""
        if stage in self._seen:
            raise ValueError(f"the stage {stage!r} is counted already")
        self._seen[stage] = Observation(stage)
        return df.observe(self._seen[stage], F.count(F.lit(1)).alias("n"))

    def get(self) -> dict[str, int]:
        """The counts, in the order of the stages; waits for the run to end."""
        return {stage: seen.get["n"] for stage, seen in self._seen.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """``(stage, n)``."""
        return spark.createDataFrame(list(self.get().items()), "stage string, n long")


def uncounted(stage: str, df: DataFrame) -> DataFrame:
    """``df`` as it is, where nothing is to be counted."""
    return df
