"""lumenframe: declarative visual analytics planned and run by Spark."""

from importlib import import_module
from typing import Any

#: Where each name lives.  Modules are loaded when a name is first asked for, so Python workers, which import this package, load none of them.
_HOMES = {"Dashboard": "plans.figure", "Figure": "plans.figure", "app": "plans.service", "mount_into": "plans.service", "register_source": "sources.registry"}

__all__ = sorted(_HOMES)


def __getattr__(name: str) -> Any:
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOMES[name]}", __name__), name)


def __dir__() -> list[str]:
    return __all__
