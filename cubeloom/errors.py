"""Error classes of the engine."""


class CubeError(ValueError):
    """Base class."""


class ParseError(CubeError):
    """A text that doesn't follow its grammar; ``line`` and ``column`` count from 1."""

    def __init__(self, message: str, source: str = "", at: int = 0):
        before = source[:at]
        self.line, self.column = before.count("\n") + 1, at - (before.rfind("\n") + 1) + 1
        super().__init__(f"{message} at {self.line}:{self.column}")


class UnknownName(CubeError):
    """A cube, dimension, member, attribute or catalog object that doesn't exist."""


class Unsupported(CubeError):
    """A construct that parses but isn't evaluated."""


class TypeMismatch(CubeError):
    """Text compared with a number."""


class InvalidWrite(CubeError):
    """A write that the coordinate's member kinds don't allow."""


class InvalidEdit(CubeError):
    """A structural edit that would break a dimension."""


class Conflict(CubeError):
    """A commit against a version that is no longer current."""


class Denied(CubeError):
    """Access refused."""


class CellError(CubeError):
    """A cell whose evaluation failed: division by zero, overflow or a cycle."""


class LimitExceeded(CubeError):
    """A size guard."""
