"""Failure values, outcomes and errors."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

PRESENT, DROPPED, FAILED, SUPPRESSED = "PRESENT", "DROPPED", "FAILED", "SUPPRESSED"
OUTCOMES = (PRESENT, DROPPED, FAILED, SUPPRESSED)


class CompileError(ValueError):
    """The pipeline's graph is not valid."""


class ContractError(RuntimeError):
    """A stage broke its contract; never retried."""


class BrokenContract(ContractError):
    """What the engine itself raises in a worker; a stage's own errors, whatever their names, are recovered from."""


class ExecutionError(RuntimeError):
    """A run was aborted."""


def cause_text(cause: Any) -> str | None:
    """None and strings stay, exceptions become 'module.Type: message', the rest its text, or its type's name."""
    if cause is None or isinstance(cause, str):
        return cause
    kind = type(cause)
    try:
        return f"{kind.__module__}.{kind.__qualname__}: {cause}" if isinstance(cause, BaseException) else str(cause)
    except Exception:
        return kind.__qualname__


@dataclass(frozen=True)
class RecordFailure:
    """Returned in place of a value: all outputs of this row fail."""

    cause: Any = None


@dataclass(frozen=True)
class GroupFailure:
    """As RecordFailure; the other rows of the same stage and direct parent are suppressed."""

    cause: Any = None


@dataclass(frozen=True)
class OutputIssue:
    """What stands in an output where no value is present."""

    outcome: str
    cause: str | None = None

    def __post_init__(self) -> None:
        if self.outcome not in OUTCOMES[1:]:
            raise ValueError(f"not an issue: {self.outcome}")
        if self.cause is not None and (not isinstance(self.cause, str) or self.outcome == DROPPED):
            raise ValueError("only failed and suppressed items have a cause, which is text")
