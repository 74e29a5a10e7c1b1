"""A search and aggregation engine over DataFrames: retrieval language, scoring, pipelines, hybrid ranking."""

from .plans.catalog import Catalog, FieldDef, IndexDef
from .plans.commands import CommandError, Engine

__all__ = ["Catalog", "CommandError", "Engine", "FieldDef", "IndexDef"]
