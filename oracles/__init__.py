"""For every query SQL can express, the same result as one statement for another engine."""

from oracles.statements import ORACLES

__all__ = ["ORACLES"]
