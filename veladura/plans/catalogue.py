"""All queries of the library outside its training-data operators."""

from veladura.streaming import logs, states  # noqa: F401

from . import cases, detection, files, ledgers, models, relational, texts  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
