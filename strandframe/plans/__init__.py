"""Registered queries over the driver tables, each with its SQL check."""

import importlib

FAMILIES = ("matrix", "sequences", "coordinates", "statistics", "sets", "search", "learning", "formats", "files")


def load() -> None:
    """Import every module of registered queries."""
    for name in FAMILIES:
        importlib.import_module(f"{__name__}.{name}_queries")
