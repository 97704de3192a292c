"""Lineage-aware nested dataflows on Spark."""

from .failures import CompileError, ContractError, ExecutionError, GroupFailure, OutputIssue, RecordFailure
from .functions.recovery import RecoveryPolicy
from .functions.stages import function, module, native
from .operators import structural as ops
from .pipeline import Executor, Pipeline, Plan, RunResult, run

__all__ = ["CompileError", "ContractError", "ExecutionError", "Executor", "GroupFailure", "OutputIssue", "Pipeline", "Plan", "RecordFailure", "RecoveryPolicy", "RunResult", "function", "module", "native", "ops", "run"]
