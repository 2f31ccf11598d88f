"""Sluice: a release gate for tables of any size, written as Spark jobs."""

from sluice.contract import Contract, ContractError, FieldRule

__all__ = ["Contract", "ContractError", "FieldRule"]
