"""Errors that a user of the engine can cause."""


class RuleError(ValueError):
    """A statement that cannot be accepted: syntax, safety, arity, stratification, types."""


class SyntaxProblem(RuleError):
    """Text that is no statement."""
