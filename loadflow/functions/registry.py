"""The function table that users may extend."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column

from loadflow.functions import cond, dates, numeric, string
from loadflow.operators import aggregates

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register(name: str, fn: Callable[..., Column]) -> None:
    """A function under a name, without regard to case; a known name is replaced."""
    FUNCTIONS[name.lower()] = fn


def call(name: str, *args: object) -> Column:
    """The function's column. An unknown name raises KeyError, a wrong number of arguments TypeError."""
    fn = FUNCTIONS.get(name.lower())
    if fn is None:
        raise KeyError(f"unknown function {name}")
    inspect.signature(fn).bind(*args)
    return fn(*args)


for _module in (cond, string, numeric, dates, aggregates):
    for _name, _fn in vars(_module).items():
        if _name[0].isupper() and inspect.isfunction(_fn) and _fn.__module__ == _module.__name__:
            register(_name, _fn)
for _name, _fn in {
    "FAbs": numeric.Abs, "FMod": numeric.Mod, "Num#": numeric.Num, "Date#": dates.Date, "Timestamp#": dates.Timestamp, "UTC": dates.Now, "LocalTime": dates.Now,
}.items():
    register(_name, _fn)
