"""Named queries over the given tables, each with its SQL oracle where SQL can say the same."""

from importlib import import_module

MODULES = ("features", "data", "folds", "channels", "metrics", "blending", "shape")


def load():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .common import ORACLE, QUERIES

    return QUERIES, ORACLE
