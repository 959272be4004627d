"""Queries on the driver tables, and the SQL each is compared with."""


def load():
    """The registry, with every module that registers into it imported."""
    import importlib

    from checks import base

    for name in ("bars", "indicators", "strategies", "research", "boards", "events"):
        try:
            importlib.import_module(f"checks.{name}")
        except ModuleNotFoundError as e:
            if f"checks.{name}" not in str(e):
                raise
    return base
