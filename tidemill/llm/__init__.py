"""Operators over corpus text: token ids, window packing, subjects. Nothing outside this subpackage imports it."""

import importlib


def modules() -> list:
    """The modules that register queries."""
    return [importlib.import_module(f"{__name__}.{m}") for m in ("queries",)]
