"""Every query of the library by name, with its SQL where SQL can say it."""

from . import arrays, documents, reports, signals, tables, traces, validation  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
