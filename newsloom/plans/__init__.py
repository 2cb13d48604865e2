"""Named queries over a data folder, and the SQL they are checked against."""

import importlib

from newsloom.plans.registry import Registry, core

MODULES = ("time", "articles", "stories", "reads")


def load() -> Registry:
    """The registry with every core query."""
    for name in MODULES:
        importlib.import_module(f"newsloom.plans.{name}")
    return core
