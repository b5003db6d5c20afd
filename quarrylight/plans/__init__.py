"""Registered queries and their SQL, by area."""

from quarrylight.plans import general, reference

MODULES = (general, reference)
