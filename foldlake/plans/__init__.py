"""Registered queries over the provided tables."""

from importlib import import_module

MODULES = (
    "structures", "pairs", "geometry", "retrieval", "transfer", "splits", "batches", "evaluation", "runs",
)


def load_all() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
