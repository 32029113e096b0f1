"""Links among the variants of one text, without pairing them.

Very many texts that were made from one by different edits are alike by less than they must be,
but by far more than strangers, so any index by likeness hands out nearly all their pairs. Here a
region of such texts has a base, the shingles that over half of its members hold, and each member
is told by its differences: the base's shingles that it lacks (m of them) and its own that the base
lacks (e). With SIMILAR = many / of, the weight of * m + many * e and room = (of - many) * size of the
base, two members x and y are alike exactly if

    (of + many) * shared differences >= x.weight + y.weight - room.

1. Members whose weight fits the room with that of the lightest member are linked to it as they are.
2. Every other link has a heavy end (one that doesn't fit) and shares differences, which are about half of
   them or more. It is found by a prefix filter: differences in order from the rarest of the region on;
   of the heavier end a prefix long enough for any lighter partner, of the lighter end one long
   enough for any heavier partner. The rest is verified by the shingle sets.

Both are exact, whatever the members of a region have to do with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def differences(members: DataFrame, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """members: region, node, root, hashes (distinct). Returns region, node, root, odd (the differences), n (their
    number), weight, room of every member, and region, h, rare (members that differ in shingle h)."""
    many, of = similar
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("members"))
    held = members.select("region", F.explode("hashes").alias("h")).groupBy("region", "h").agg(F.count(F.lit(1)).alias("held"))
    common = 2 * F.col("held") > F.col("members")
    rare = F.when(common, F.col("members") - F.col("held")).otherwise(F.col("held"))
    held = written(held.join(sizes.hint("merge"), "region").select("region", "h", common.alias("common"), rare.alias("rare")), "region-shingles")
    bases = written(held.where("common").groupBy("region").agg(F.collect_list("h").alias("base")), "region-bases")
    base = F.coalesce("base", F.array().cast("array<bigint>"))
    told = members.join(bases.hint("merge"), "region", "left").select(
        "region",
        "node",
        "root",
        F.array_except(base, "hashes").alias("lacks"),
        F.array_except("hashes", base).alias("own"),
        ((of - many) * F.size(base)).cast("bigint").alias("room"),
    )
    weight = of * F.size("lacks") + many * F.size("own")
    odd = F.concat("lacks", "own")
    told = told.select("region", "node", "root", odd.alias("odd"), F.size(odd).cast("bigint").alias("n"), weight.cast("bigint").alias("weight"), "room")
    return written(told, "differences"), held.select("region", "h", "rare")


def _places(told: DataFrame, rare: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The differences in the prefixes: their place in the member's order, and the ends of its prefixes as the
    heavier (0 if it isn't heavy) and as the lighter of two."""
    many, of = similar

    def prefix(partner: Column) -> Column:
        """How many differences hold one that is shared with any partner of so much weight or more."""
        return F.col("n") + 1 - F.ceil((F.col("weight") + partner - F.col("room")) / F.lit(of + many))

    fits = F.col("room") - F.col("least")
    # a link's lighter end has differences enough to share
    as_heavier = prefix(F.greatest(F.col("least"), F.ceil(many * (F.col("weight") - F.col("room")) / F.lit(of))))
    told = told.withColumn("as_heavier", F.when(F.col("weight") > fits, as_heavier).otherwise(0))
    told = told.withColumn("as_lighter", prefix(F.greatest(F.col("weight"), fits + 1)))
    each = told.withColumn("h", F.explode("odd")).drop("odd", "least").join(rare.hint("merge"), ["region", "h"])
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("rare", "h")))
    return each.where((F.col("rare") > 1) & (F.col("place") <= F.greatest("as_heavier", "as_lighter"))).drop("rare")


def variant_pairs(members: DataFrame, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """members: region, node, root, hashes (distinct). Returns links (a, b) that hold, and pairs (a, b) of unlike
    roots to be verified: together they join all members of a region that are as alike as ``similar``, as
    far as the roots don't."""
    many, of = similar
    told, rare = differences(members, similar)
    least = F.min(F.struct("weight", "node"))
    marks = told.groupBy("region").agg(
        least.getField("weight").alias("least"),
        least.getField("node").alias("lightest"),
        ((F.max("weight") + F.min("weight") > F.first("room")) & (F.min("root") < F.max("root"))).alias("open"),
    )
    marked = written(told.join(written(marks, "region-marks").hint("merge"), "region"), "marked")
    links = marked.where("weight + least <= room and node <> lightest").select(F.col("lightest").alias("a"), F.col("node").alias("b"))
    places = written(_places(marked.where("open").drop("open", "lightest"), rare, similar), "places")
    x, y = places.where("place <= as_heavier").alias("x"), places.where("place <= as_lighter").alias("y")
    lighter = (F.col("y.weight") < F.col("x.weight")) | ((F.col("y.weight") == F.col("x.weight")) & (F.col("y.node") < F.col("x.node")))
    most = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))  # if this is the first that they share
    enough = (of + many) * most >= F.col("x.weight") + F.col("y.weight") - F.col("x.room")
    shared = (F.col("x.region") == F.col("y.region")) & (F.col("x.h") == F.col("y.h"))
    met = x.join(y.hint("merge"), shared & lighter & enough & (F.col("x.root") != F.col("y.root")))
    return links, written(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "variant-pairs")
