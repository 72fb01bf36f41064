"""Named queries over the sample tables, each with its SQL counterpart where SQL can say it."""

from . import files, live, market, models, robust, trading  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
