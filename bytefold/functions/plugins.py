"""Plug-ins found by importing the modules of a package."""

from __future__ import annotations

import importlib
import pkgutil
import warnings


def import_modules(package: str, prefix: str = "") -> list[str]:
    """Import the modules of a package whose names begin with ``prefix``; those that worked."""
    root = importlib.import_module(package)
    done = []
    for info in sorted(pkgutil.walk_packages(root.__path__, f"{package}."), key=lambda m: m.name):
        if not info.name.rsplit(".", 1)[-1].startswith(prefix):
            continue
        try:
            importlib.import_module(info.name)
            done.append(info.name)
        except Exception as error:  # a broken plug-in must not stop the others
            warnings.warn(f"{info.name} can't be imported: {error}", stacklevel=2)
    return done
