"""Operators of the pattern-discovery engine; each module adds named relations to a plan."""
