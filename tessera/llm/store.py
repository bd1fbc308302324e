"""Intermediate tables of the corpus operators."""

from tessera.store import cut, drop, shared_dir

__all__ = ["cut", "drop", "shared_dir"]
