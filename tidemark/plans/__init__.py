"""Lenses: the operators applied to whole tables, each with its SQL."""
