"""Hybrid search, grounding and consensus over large source trees, as PySpark DataFrame plans."""

from .config import Settings, load_settings
from .shipping import ship

__all__ = ["Settings", "load_settings", "ship"]
