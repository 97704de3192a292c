"""What happens when a Python stage raises."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..failures import BrokenContract, RecordFailure


@dataclass(frozen=True)
class RecoveryPolicy:
    """kind: abort, retry_batch, retry_tail or isolate_tail.  infra_retries is Spark's own (spark.task.maxFailures)."""

    kind: str = "abort"
    max_retries: int = 0
    infra_retries: int = 1

    def __post_init__(self) -> None:
        for n in (self.max_retries, self.infra_retries):
            if type(n) is not int or n < 0:
                raise ValueError("retry budgets are integers from 0")
        want = {"abort": self.max_retries == 0, "retry_batch": self.max_retries > 0, "retry_tail": self.max_retries > 0, "isolate_tail": self.max_retries == 1}
        if not want.get(self.kind, False):
            raise ValueError(f"{self.kind} with {self.max_retries} retries")

    @classmethod
    def abort(cls, infra_retries: int = 1) -> RecoveryPolicy:
        return cls("abort", 0, infra_retries)

    @classmethod
    def retry_batch(cls, max_retries: int = 1) -> RecoveryPolicy:
        return cls("retry_batch", max_retries)

    @classmethod
    def retry_tail(cls, max_retries: int = 1) -> RecoveryPolicy:
        return cls("retry_tail", max_retries)

    @classmethod
    def isolate_tail(cls) -> RecoveryPolicy:
        return cls("isolate_tail", 1)

    @property
    def at_tail(self) -> bool:
        """Whether failed batches wait until a partition's fresh ones are through."""
        return self.kind in ("retry_tail", "isolate_tail")

    def again(self, call: Callable[[list], list], rows: list) -> list:
        """Results of rows whose first call has raised."""
        for k in range(self.max_retries):
            try:
                return call(rows)
            except BrokenContract:
                raise
            except Exception:
                if k + 1 == self.max_retries and self.kind != "isolate_tail":
                    raise
        return [x for half in self._halves(rows) for x in self._isolated(call, half)]

    @staticmethod
    def _halves(rows: list) -> list[list]:
        cut = len(rows) // 2
        return [rows[:cut], rows[cut:]] if cut else [rows]

    def _isolated(self, call: Callable[[list], list], rows: list) -> list:
        try:
            return call(rows)
        except BrokenContract:
            raise
        except Exception as e:
            if len(rows) == 1:
                return [RecordFailure(e)]
            return [x for half in self._halves(rows) for x in self._isolated(call, half)]
