"""A lakehouse on Spark: tables of Parquet files whose metadata lives in a SQL database."""

from . import types
from .errors import *  # noqa: F403
from .identifiers import TableName
from .lake import Lake, LakeTable, connect, create
from .operators.write import WriteDataFile
from .types import Column, Partitioning, Schema

__all__ = ["Column", "Lake", "LakeTable", "Partitioning", "Schema", "TableName", "WriteDataFile", "connect", "create", "types"]
