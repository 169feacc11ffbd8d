"""Queries by operator family."""

from importlib import import_module

FAMILIES = ["scalar", "calls", "intervals", "coverage", "tracks", "hits", "mutants", "tables", "files"]


def all_modules() -> None:
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
