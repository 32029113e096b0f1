"""Named functions of a session, alone or in groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class FunctionRegistry:
    """Functions by canonical name and alias; names, functions and aliases are unique."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.functions: dict[str, Callable] = {}
        self.aliases: dict[str, str] = {}
        self.groups: dict[tuple[str, str], list[str]] = {}

    def register(self, name: str, function: Callable, alias: str | None = None, return_type: str = "string") -> None:
        if name in self.functions or name in self.aliases or function in self.functions.values():
            raise ValueError(f"{name!r} or its function is registered already")
        if alias and (alias in self.aliases or alias in self.functions):
            raise ValueError(f"the alias {alias!r} is taken")
        if hasattr(function, "evalType"):  # a user-defined function has its type
            self.spark.udf.register(name, function)
        else:
            self.spark.udf.register(name, F.udf(function, return_type, useArrow=True))
        self.functions[name] = function
        if alias:
            self.aliases[alias] = name

    def group(self, name: str, version: str = "") -> Callable[..., Callable[[Callable], Callable]]:
        """A decorator for the functions of a group: ``@group("sub")`` registers one as ``name_sub``."""

        def member(sub: str, return_type: str = "string", alias: str | None = None) -> Callable[[Callable], Callable]:
            def take(function: Callable) -> Callable:
                self.register(f"{name}_{sub}", function, alias, return_type)
                self.groups.setdefault((name, version), []).append(sub)
                return function

            return take

        return member

    def resolve(self, name: str) -> str:
        name = self.aliases.get(name, name)
        if name not in self.functions:
            raise KeyError(name)
        return name

    def deregister(self, name: str) -> None:
        name = self.resolve(name)
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{name}`")
        del self.functions[name]
        self.aliases = {a: n for a, n in self.aliases.items() if n != name}

    def call(self, name: str, *columns: Column) -> Column:
        return F.call_function(self.resolve(name), *columns)

    def listing(self) -> DataFrame:
        """name, alias of what is registered."""
        back = {n: a for a, n in self.aliases.items()}
        return self.spark.createDataFrame([(n, back.get(n)) for n in sorted(self.functions)], "name string, alias string")


def choices(rows: DataFrame, column: str, prefix: str, case_sensitive: bool = True) -> DataFrame:
    """Distinct values that begin with the prefix."""
    found = F.col(column).startswith(prefix) if case_sensitive else F.lower(column).startswith(prefix.lower())
    return rows.where(found).select(column).distinct()
