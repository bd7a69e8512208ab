"""Registered queries, one module per operator family. Importing this package fills the registry."""

from importlib import import_module

FAMILIES = ["corpus", "sampling", "vocab", "sequences", "blanks", "tasks", "prompts", "layouts", "metrics", "files", "scalars"]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
