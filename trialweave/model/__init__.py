"""Table model: a DataFrame with typed missing markers and metadata."""

from .missing import MISSING_CODES, MISSING_TEXT
from .table import Table, mis

__all__ = ["MISSING_CODES", "MISSING_TEXT", "Table", "mis"]
