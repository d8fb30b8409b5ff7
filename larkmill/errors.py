"""Errors of the engine; their messages are stable enough to test against."""


class EngineError(Exception):
    """Anything a statement can fail with."""


class SyntaxProblem(EngineError):
    """The text is no statement of the dialect."""


class PlanProblem(EngineError):
    """The statement is well formed but cannot be planned: unknown names, misplaced aggregates and the like."""


class CatalogProblem(EngineError):
    """An entity exists already, is missing, or is still in use."""
