"""Code for executors that have no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """Let tasks carry a module's functions and classes by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)
