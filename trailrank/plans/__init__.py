"""Named queries; ``load_all`` registers every module of the folder that defines some."""
from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    for module in iter_modules(__path__):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")
