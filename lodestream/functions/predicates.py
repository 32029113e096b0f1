"""Predicates on names, keys, values and lines. Where a whole text must match, the end anchor is
``\\z``: ``$`` would let one trailing line feed pass."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .text import is_printable, nfc

#: Fixed values.
SHELL_META = ";|&><`!"
ALLOWED_COMMANDS = ["echo", "ls", "cat", "grep"]


def contains(text: Column, needle: str | None) -> Column:
    """Case-sensitive; without a needle everything passes. Of a null it is null, so that scans can push it down."""
    return text.contains(needle) if needle else F.lit(True)


def has_prefix(text: Column, prefix: str, case_sensitive: bool = True) -> Column:
    return text.startswith(prefix) if case_sensitive else F.lower(text).startswith(prefix.lower())


# The patterns of config keys, plugin names, versions and env lines are fixed values.


def is_config_key(key: Column) -> Column:
    return key.rlike(r"^[A-Za-z0-9_]+\z")


def is_plugin_name(name: Column) -> Column:
    return name.rlike(r"^[a-zA-Z0-9_-]+\z")


def is_version(text: Column) -> Column:
    """Three dotted numbers, at most 1024 characters."""
    return text.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\z") & F.length(text).between(1, 1024)


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*\z")


def is_printable_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x20-\x7E]*\z")


def is_memory_key(key: Column) -> Column:
    """1 to 4096 printable characters that aren't white space."""
    return F.length(key).between(1, 4096) & ~key.rlike(r"\s") & is_printable(key)


def is_env_line(line: Column) -> Column:
    """Blank, a comment, or NAME=value of plain characters."""
    return line.rlike(r"^\s*(#.*)?\z") | line.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=[A-Za-z0-9_./\-]*\z")


def is_allowed(command: Column, allowed: list[str] | None = None) -> Column:
    """The command's base name is on the list."""
    return F.element_at(F.split(command, "/"), -1).isin(allowed or ALLOWED_COMMANDS)


def has_shell_meta(args: Column) -> Column:
    """Any of the arguments holds a shell metacharacter."""
    return F.exists(args, lambda a: a.rlike("[" + SHELL_META + "]"))


def same_name(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def same_composed(a: Column, b: Column) -> Column:
    return nfc(a) == nfc(b)


def is_recorded(command: Column, disabled: bool = False) -> Column:
    """Not empty, and neither a look at the history nor a call for help."""
    first = F.element_at(F.split(F.trim(F.coalesce(command, F.lit(""))), r"\s+"), 1)
    return F.lit(not disabled) & (first != "") & ~first.isin("history", "help")


def flags_overlap(a: Column, b: Column) -> Column:
    """Whether two sets of flags have one in common; null holds none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def health_of(told: Column) -> Column:
    """``healthy``, ``degraded`` or ``unhealthy`` of a told state in any case; all else is unhealthy."""
    state = F.lower(told)
    return F.when(state.isin("healthy", "degraded"), state).otherwise("unhealthy")


def health(result: Column) -> Column:
    return F.when(result, "healthy").otherwise("unhealthy")


def satisfies(spec: str):
    """A predicate: the version lies in the specifier set (``>=1.0,<2``); malformed ones don't."""

    @F.pandas_udf(BooleanType())
    def inside(versions: pd.Series) -> pd.Series:
        from packaging.specifiers import SpecifierSet
        from packaging.version import InvalidVersion, Version

        wanted = SpecifierSet(spec)

        def holds(text: str | None) -> bool:
            try:
                return text is not None and Version(text) in wanted
            except InvalidVersion:
                return False

        return versions.map(holds)

    return inside
