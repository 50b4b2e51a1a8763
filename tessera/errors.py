"""Errors that statements raise."""


class EngineError(Exception):
    """Any error of a statement."""


class SyntaxProblem(EngineError):
    """The text is no statement of the dialect."""


class BindProblem(EngineError):
    """A table, column or value does not fit the catalog."""


class TransactionProblem(EngineError):
    """A transaction command that does not fit the session's state, or a commit that lost against another."""


class LockConflict(TransactionProblem):
    """Another transaction holds a lock that excludes this one."""
