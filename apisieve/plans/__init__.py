"""Declarations of queries, their validation and normalisation, and physical roots."""

from .dsl import AnyQuery, Catalog, EventQuery, Identity, Lifecycle, Rule, Value, all_of, any_of
from .physical import Root, compile_queries, explain
from .validate import InvalidQuery

__all__ = ["AnyQuery", "Catalog", "EventQuery", "Identity", "InvalidQuery", "Lifecycle", "Root", "Rule", "Value", "all_of", "any_of", "compile_queries", "explain"]
