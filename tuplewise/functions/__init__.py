"""Predicates, row functions and aggregators: host-language callables as column expressions."""
