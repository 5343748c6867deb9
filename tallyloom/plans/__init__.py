"""Registered queries; importing this package registers all of them."""

import importlib
import pkgutil

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_module}")
