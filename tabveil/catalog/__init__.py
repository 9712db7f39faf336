"""Every registered query, by subject."""

from __future__ import annotations

import importlib

from tabveil.catalog.registry import REGISTRY, Query

SUBJECTS = ["cleaning", "generalising", "deriving", "drawing", "personal_data", "comparing", "predicting", "attacking", "synthesizing", "filing", "reporting"]


def load() -> dict[str, Query]:
    for subject in SUBJECTS:
        importlib.import_module(f"tabveil.catalog.{subject}")
    return REGISTRY
