"""Named queries (operator applied to tables) and their SQL twins."""

import importlib
import pkgutil


def modules() -> list:
    """Every module of this package that registers queries."""
    found = [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]
    return [m for m in found if hasattr(m, "QUERIES")]
