"""Operators that prepare text and code corpora for training. Nothing outside this package imports it."""

from quarrylight.llm import queries

MODULES = (queries,)
