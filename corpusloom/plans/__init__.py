"""The registered queries, by area."""

from __future__ import annotations

import importlib

AREAS = ["search", "corpus", "retrieval", "conversations", "alignment", "answers"]


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
