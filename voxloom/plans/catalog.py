"""All queries of the reference's operators by name."""

from . import corpus, models, sampling, vectors  # noqa: F401
from .base import CATALOG

__all__ = ["CATALOG"]
