"""Column functions for cleaning, escaping, splitting and parsing text.

Everything is a built-in expression, but for what Spark has no expression for: Unicode
normal forms, the escape grammar of Python strings and POSIX shell splitting are Arrow-batched
Python functions.
"""

from __future__ import annotations

import codecs
import re
import shlex
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

ESC = "\x1b"
CONTROLS = {c: None for c in (*range(0x20), 0x7F)}
#: A character that composes or is composed; none before the first combining mark does.
COMPOSING = r"[^\x{0}-\x{2FF}]"
#: Texts of a batch that are Python objects at once, at most.
SLICE = 64


@F.pandas_udf(StringType())
def ascii_clean(texts: pd.Series) -> pd.Series:
    """Compatibility-decomposed, without combining marks, printable ASCII only; null stays null."""

    def clean(text: str | None) -> str | None:
        if text is None or (text.isascii() and text.isprintable()):
            return text
        return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii").translate(CONTROLS)

    return texts.map(clean, na_action="ignore")


@F.arrow_udf(StringType())
def _recomposed(texts: pa.Array) -> pa.Array:
    """The composition of each text that isn't composed yet, else null."""

    def recomposed(text: pa.StringScalar) -> str | None:
        own = text.as_py()
        return None if own is None or unicodedata.is_normalized("NFC", own) else unicodedata.normalize("NFC", own)

    parts = [pa.array(map(recomposed, texts.slice(k, SLICE)), pa.string()) for k in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfc(text: Column | str) -> Column:
    """Canonical composition (NFC). Python gets only texts that may need it, and gives back only those that did."""
    own = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_recomposed(F.when(own.rlike(COMPOSING), own)), own)


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Backslash escapes decoded as in Python strings; a malformed text gives null."""

    def decode(text: str) -> str | None:
        try:
            return codecs.decode(text.encode("latin-1", "backslashreplace"), "unicode_escape")
        except UnicodeDecodeError:
            return None

    return texts.map(decode, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def shell_split(lines: pd.Series) -> pd.Series:
    """Tokens of a POSIX shell line; null where quotes don't close."""

    def split(line: str | None) -> list[str] | None:
        try:
            return None if line is None else shlex.split(line)
        except ValueError:
            return None

    return lines.map(split)


@F.pandas_udf(BooleanType())
def is_printable(texts: pd.Series) -> pd.Series:
    """All characters printable by Unicode; the empty text is."""
    return texts.map(str.isprintable, na_action="ignore")


def ascii_safe(text: Column) -> Column:
    """What is neither printable ASCII nor LF, CR or TAB becomes ``?``."""
    return F.regexp_replace(text, r"[^\x20-\x7E\n\r\t]", "?")


def escape(text: Column) -> Column:
    """Backslash, LF, CR and double quote escaped, in this order."""
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def _enclosed(text: Column, quote: str) -> Column:
    return (F.length(text) >= 2) & text.startswith(quote) & text.endswith(quote)


def strip_quotes(text: Column) -> Column:
    """Without one pair of double quotes around."""
    return F.when(_enclosed(text, '"'), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def strip_quotes_any(text: Column) -> Column:
    """Without one pair of equal quotes of either kind around, then unescaped; else as it is."""
    quoted = _enclosed(text, '"') | _enclosed(text, "'")
    return F.when(quoted, unescape(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def item_name(name: Column, most: int = 100) -> Column:
    """A name of 1 to ``most`` characters, trimmed after it was measured; null if it isn't one."""
    return F.when(F.length(name).between(1, most) & (stripped(name) != ""), stripped(name))


def now_epoch() -> Column:
    """Seconds since 1970 of the query's time."""
    return F.unix_micros(F.current_timestamp()) / 1e6


def normalise_key(key: Column, prefix: str) -> Column:
    """Trimmed of white space of all kinds, without the prefix, lower case."""
    key = stripped(key)
    bare = F.when(key.startswith(prefix), F.substring(key, F.lit(len(prefix) + 1), F.length(key))).otherwise(key)
    return F.lower(bare)


def split_key_value(line: Column) -> tuple[Column, Column]:
    """What stands before and after the first ``=``; both null without one."""
    at = F.instr(line, "=")
    return F.when(at > 0, F.substring(line, F.lit(1), at - 1)), F.when(at > 0, F.substring(line, at + 1, F.length(line)))


def strip_ansi(text: Column) -> Column:
    """Without terminal control sequences; the pattern is the public standard's, a fixed value."""
    return F.regexp_replace(text, ESC + r"\[[0-?]*[ -/]*[@-~]", "")


def _parts(line: str, by: str) -> list[str]:
    """One pass from the end over separators and quotes: a separator counts where all quotes behind it close."""
    balanced, behind, cuts = True, {}, []  # behind: for each kind of quote, whether all closes after the next one
    for mark in reversed(list(re.finditer(f"[{re.escape(by)}\"']", line))):
        if mark.group() == by:
            if balanced:
                cuts.append(mark.start())
        else:
            closes = behind.get(mark.group(), False)
            behind[mark.group()] = balanced
            balanced = closes
    edges = [-1, *reversed(cuts), len(line)]
    return [line[a + 1 : b] for a, b in zip(edges, edges[1:], strict=False)]


def split_unquoted(line: Column, by: str = ";") -> Column:
    """Parts of a line between separators that no quotes enclose."""

    @F.pandas_udf(ArrayType(StringType()))
    def quoted(lines: pd.Series) -> pd.Series:
        return lines.map(lambda text: _parts(text, by), na_action="ignore")

    # only lines with both leave the JVM
    both = line.contains(by) & line.rlike("[\"']")
    return F.when(both, quoted(F.when(both, line))).otherwise(F.split(line, F.lit(f"\\Q{by}\\E")))


def normal_format(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def parse_enum(name: Column, allowed: list[str]) -> Column:
    """The member that the text names in any case; null if none."""
    return F.when(F.lower(name).isin(allowed), F.lower(name))


def parse_bool(value: Column) -> Column:
    """True or false for these words in any case; null for all else."""
    return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)


def parse_float(value: Column) -> Column:
    """A number, or that under ``value`` in a JSON object; null for all else."""
    return F.coalesce(value.try_cast("double"), F.get_json_object(value, "$.value").try_cast("double"))


def whole_milliseconds(seconds: Column) -> Column:
    """Cut off, not rounded."""
    return (seconds * 1000).cast("bigint")


def format_of(path: Column) -> Column:
    """The export format that a path's ending stands for."""
    low = F.lower(path)
    return F.when((path == "-") | low.endswith(".env"), "env").when(low.endswith(".yaml") | low.endswith(".yml"), "yaml").otherwise("json")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def redact(value: Column, shown: str = "***") -> Column:
    """The mask wherever there is a value."""
    return F.when(value.isNotNull(), F.lit(shown))


def backoff_delay(attempt: Column, delay: float, factor: float, jitter: float = 0.0) -> Column:
    """Seconds before an attempt, give or take ``jitter``; attempts count from 0."""
    plain = F.lit(delay) * F.pow(F.lit(factor), attempt)
    return plain + (F.rand() * 2 - 1) * jitter if jitter else plain


def json_field(text: Column, name: str, default: str | None = None) -> Column:
    """A field of a JSON object as text, or the default where it is absent or null."""
    found = F.get_json_object(text, f"$.{name}")
    return found if default is None else F.coalesce(found, F.lit(default))


def shown(value: Column, kind: str = "string") -> Column:
    """Text of a value as Python shows it: ``None``, ``True``, ``False``."""
    text = F.initcap(value.cast("string")) if kind == "boolean" else value.cast("string")
    return F.coalesce(text, F.lit("None"))


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    seconds = F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def epoch_seconds(ts: str) -> Column:
    return epoch_micros(ts) / 1e6
