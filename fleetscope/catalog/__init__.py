"""Every query of the library on the shared test tables, each with its expected-result SQL."""

import importlib
import pkgutil


def load():
    """Import all query modules and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
