"""Lines of text: segments, the tree of commands, the nearest known name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_unquoted, strip_ansi

#: Where Python's splitlines() ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def segments(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per command of a text: lines, parted at semicolons outside quotes, trimmed, not empty.

    Lines and parts that begin with ``#`` are comments; a line that begins with a semicolon is no command.
    """
    lines = df.select(*keep, F.posexplode(F.split(strip_ansi(F.col(text)), LINE_END)).alias("line", "content"))
    lines = lines.where(~F.col("content").rlike(r"(?U)^\s*[#;]"))
    parts = lines.select(*keep, "line", F.posexplode(split_unquoted(F.col("content"))).alias("part", "segment"))
    trimmed = F.regexp_replace("segment", r"(?U)^\s+|\s+\z", "")
    return parts.withColumn("segment", trimmed).where("segment <> '' AND NOT startswith(segment, '#')")


def tree_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All paths from the roots down a tree of (parent, child): path, depth, leaf name."""
    return edges.sparkSession.sql(
        """
        WITH RECURSIVE walk(name, path, depth) AS (
            SELECT name, name, 0 FROM {roots}
            UNION ALL
            SELECT e.child, concat(w.path, ' ', e.child), w.depth + 1
            FROM walk w JOIN {edges} e ON e.parent = w.name
        )
        SELECT name, path, depth FROM walk""",
        edges=edges,
        roots=roots,
    )


def nearest_name(word: Column, known: list[str], most: int = 3) -> Column:
    """The known name of least edit distance, at most ``most`` and not the word itself, else null.

    The distance is Levenshtein's; ties go to the first in order.
    """
    scored = F.array(*[F.struct(F.levenshtein(word, F.lit(k)).alias("distance"), F.lit(k).alias("name")) for k in sorted(known)])
    best = F.array_min(scored)
    return F.when((best["distance"] <= most) & (best["distance"] > 0), best["name"])
