"""Control of a sweep: trials in blocks that can be cancelled, fail by themselves, and are not run twice.

A block of trials is one Spark job under a job tag, so `Study.cancel` stops the running one from another thread. A block's
rows are written below the study's folder before they count; a study that is started again on the folder skips the blocks
that it finds whole. A block that fails is halved until the failing trials stand alone; these become rows with the error.
Rules are read from the frame per block, so a rule that can't be read fails its own trials only.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.frames import Rule
from barloom.operators.sweep import MAX_TRIALS, best, trials_of

TRIALS = "trial int, buy_mask int, sell_mask int, n_trades bigint, profit double, state string, error string"
COMPLETE, FAILED, CANCELLED = "COMPLETE", "FAIL", "CANCELLED"


@dataclass
class Study:
    """An exhaustive study over subsets of buy and sell rules on a frame, in folder.

    objective: a column of the trials' rows or a function from their columns to one (higher is better if maximise).
    """

    frame: DataFrame
    buy: Sequence[Rule]
    sell: Sequence[Rule]
    budget: float
    folder: str
    buy_operator: str = "and"
    sell_operator: str = "or"
    may_buy: Column | None = None
    may_sell: Column | None = None
    objective: str | Callable[[DataFrame], Column] = "profit"
    maximise: bool = True
    block: int = 256
    progress: Callable[[int, int], None] = lambda done, total: None
    tag: str = field(default_factory=lambda: f"study-{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        self._stop = threading.Event()
        if not self.buy or not self.sell:
            raise ValueError("a study needs buy and sell rules")
        if self.trials > MAX_TRIALS:
            raise ValueError(f"{self.trials} trials are more than {MAX_TRIALS}")
        if self.block < 1:
            raise ValueError("a block has one trial at least")

    @property
    def trials(self) -> int:
        return (2 ** len(self.buy) - 1) * (2 ** len(self.sell) - 1)

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    def cancel(self) -> None:
        """Stop after, or in, the block that runs: its jobs are cancelled, its trials not kept. Any thread may call this."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _at(self, block: int) -> str:
        return f"{self.folder.rstrip('/')}/block={block:05d}"

    def _done(self, block: int) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(block)}/_SUCCESS")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def _rows(self, trials: range) -> DataFrame:
        scores = trials_of(self.frame, self.buy, self.sell, self.budget, trials, self.buy_operator, self.sell_operator, self.may_buy, self.may_sell)
        return scores.withColumns({"state": F.lit(COMPLETE), "error": F.lit(None).cast("string")})

    def _failed(self, trial: int, error: Exception) -> DataFrame:
        width = 2 ** len(self.sell) - 1
        row = (trial, trial // width + 1, trial % width + 1, None, None, FAILED, f"{type(error).__name__}: {error}"[:2000])
        return self.spark.createDataFrame([row], TRIALS)

    def _tried(self, trials: range) -> list[DataFrame]:
        """Rows of the trials in written tables; halves what fails."""
        at = f"{self.folder.rstrip('/')}/_parts/{uuid.uuid4().hex}"
        try:
            self._rows(trials).write.parquet(at)
            return [self.spark.read.parquet(at)]
        except Exception as error:  # whatever the plan or its tasks raise is the trial's failure
            if self._stop.is_set():
                raise
            if len(trials) == 1:
                return [self._failed(trials[0], error)]
            half = len(trials) // 2
            return self._tried(trials[:half]) + self._tried(trials[half:])

    def run(self) -> DataFrame:
        """All trials' rows so far; RuntimeError if every trial of a finished study failed.

        A cancelled study returns the blocks that are whole, and `state()` says so.
        """
        context, total, done = self.spark.sparkContext, self.trials, 0
        context.addJobTag(self.tag)
        try:
            for k, first in enumerate(range(0, total, self.block)):
                trials = range(first, min(first + self.block, total))
                if not self._done(k):
                    if self._stop.is_set():
                        break
                    try:
                        parts = self._tried(trials)
                        rows = parts[0]
                        for more in parts[1:]:
                            rows = rows.unionByName(more)
                        if not self._stop.is_set():
                            rows.coalesce(1).write.mode("overwrite").parquet(self._at(k))  # at most a block of rows
                    except Exception:
                        if not self._stop.is_set():
                            raise
                    if self._stop.is_set():
                        break
                done += len(trials)
                self.progress(done, total)
        finally:
            context.removeJobTag(self.tag)
            self._delete("_parts")
        found = self.found()
        if done == total and found.where(F.col("state") == COMPLETE).isEmpty():
            raise RuntimeError(f"all {total} trials failed: {found.agg(F.min('error')).first()[0]}")
        return found

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/{name}")
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def found(self) -> DataFrame:
        """The rows of all whole blocks."""
        blocks = [self._at(k) for k in range(-(-self.trials // self.block)) if self._done(k)]
        if not blocks:
            return self.spark.createDataFrame([], TRIALS)
        return self.spark.read.schema(TRIALS).parquet(*blocks)

    def scored(self) -> DataFrame:
        """found() with value, the objective; null for failed trials."""
        rows = self.found()
        value = F.col(self.objective) if isinstance(self.objective, str) else self.objective(rows)
        return rows.withColumn("value", F.when(F.col("state") == COMPLETE, value.try_cast("double")))

    def best(self) -> DataFrame:
        """The best trial's row, the first of ties; none if none is complete."""
        return best(self.scored().where(F.col("state") == COMPLETE), "value", self.maximise)

    def state(self) -> dict[str, int]:
        """Trials by state, those not run as CANCELLED or, before a run, missing."""
        counts = {r["state"]: r["count"] for r in self.found().groupBy("state").count().collect()}
        left = self.trials - sum(counts.values())
        return {**counts, **({CANCELLED: left} if left and self._stop.is_set() else {})}

    def result(self) -> str:
        """The study as JSON: its size, counts by state, direction, the best trial with its rules and value, and every trial's
        state and value (MAX_TRIALS at most)."""
        rows, states, top = self.scored().orderBy("trial").collect(), self.state(), self.best().first()
        picked = lambda rules, mask: [{"factor": r.factor, "threshold": r.threshold} for k, r in enumerate(rules) if mask >> k & 1]
        winner = top and {"trial": top.trial, "value": top["value"], "profit": top.profit, "n_trades": top.n_trades, "buy_rules": picked(self.buy, top.buy_mask), "sell_rules": picked(self.sell, top.sell_mask)}
        name = self.objective if isinstance(self.objective, str) else getattr(self.objective, "__name__", "objective")
        told = {
            "cancelled": CANCELLED in states, "mode": "exhaustive", "n_trials": self.trials, "buy_subset_count": 2 ** len(self.buy) - 1, "sell_subset_count": 2 ** len(self.sell) - 1,
            "completed_trials": states.get(COMPLETE, 0), "failed_trials": states.get(FAILED, 0), "best_trial": top and top.trial, "best_value": top and top["value"], "objective_key": name,
            "direction": "maximize" if self.maximise else "minimize", "best": winner, "trials": [{"number": r.trial, "state": r.state, "value": r["value"], "error": r.error} for r in rows],
        }
        return json.dumps(told, ensure_ascii=False)
