"""Fixtures of the corpus tests."""

from cases import awkward, awkward_rows, nothing  # noqa: F401
