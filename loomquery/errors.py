"""What can go wrong, by stage."""

import re


def masked(text: str) -> str:
    """A message without the secrets that connection strings hold."""
    text = re.sub(r"(?i)\b(password|passwd|pwd|user|token|secret)\s*=\s*[^;&\s,)]+", r"\1=***", text)
    return re.sub(r"://[^/\s:@]+:[^/\s@]+@", "://***@", text)


class EngineError(Exception):
    """Any error of the engine."""


class PlanError(EngineError):
    """The plan is not valid over the catalog."""


class AmbiguousColumn(PlanError):
    """A column name fits several tables."""


class ExecutionError(EngineError):
    """Spark could not run a valid plan."""


class QueryTimeout(ExecutionError):
    """The query took longer than allowed."""


class ContractError(EngineError):
    """A result does not have the shape its intent promises."""
