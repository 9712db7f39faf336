"""Tabular privacy analytics on Spark: generalise, synthesise, measure, audit."""

from tabveil.roles import Roles

__all__ = ["Roles"]
