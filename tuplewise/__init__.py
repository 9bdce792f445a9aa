"""A relational algebra over Spark DataFrames."""

from tuplewise.definitions import definitions
from tuplewise.functions.predicates import group_function, row_function, value_function
from tuplewise.operators import *  # noqa: F403
from tuplewise.operators import __all__ as _operators
from tuplewise.relation import DEE, DUM, Relation, is_relation

__all__ = ["DEE", "DUM", "Relation", "definitions", "group_function", "is_relation", "row_function", "value_function", *_operators]
