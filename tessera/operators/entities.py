"""Names that are nearly the same, found without comparing all of them.

Two names are alike if their edit distance is at most ``SHARE`` of the longer one's length. At distance d, one of any d + 1 parts
of the shorter name stands unchanged in the longer one, moved by no more than the edits on either side allow; so the shorter
name is cut into d + 1 parts, the longer one gives its pieces at the places where they may have come from, and both meet on
them. With parts of as many characters as a share of a tenth leaves, few meet that are not alike. Of names beyond ``LONG``
characters that would be too many pieces; they meet on their rarest grams: an edit changes at most ``GRAM`` of a name's
grams, so one of the other's grams is among any ``GRAM * d + 1`` of its own. Candidates are verified either way. Equal names are
one name before any of this, and a block that is still crowded is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import _paired
from tessera.session import stored

SHARE, GRAM, LONG = 0.1, 3, 120


def similar_names(names: DataFrame, name_col: str = "name", share: float = SHARE, long: int = LONG) -> DataFrame:
    """``a, b, distance``: pairs of different names (``a < b``) that are alike. Null and empty names are like none."""
    own = names.select(F.col(name_col).alias("x")).where("length(x) > 0").distinct().withColumn("n", F.length("x"))
    # the most edits that a pair with this name may have: the other is at most as much longer
    edits = F.floor(F.col("n") * F.lit(share / (1 - share)) + F.lit(1e-9)).cast("int")
    own = stored(own.withColumn("d", edits).where("d > 0"))
    met = _by_parts(own.where(F.col("n") <= long), share).unionByName(_by_grams(own.where(F.col("n") + F.col("d") > long)).where(F.greatest("na", "nb") > long))
    most = F.floor(F.greatest("na", "nb") * F.lit(share) + F.lit(1e-9)).cast("int")
    far = met.withColumn("most", most).where("abs(na - nb) <= most").select("a", "b", "most").distinct()
    return far.withColumn("distance", F.levenshtein("a", "b")).where("distance <= most").select("a", "b", "distance")


def _by_parts(own: DataFrame, share: float) -> DataFrame:
    """``a, na, b, nb``: candidates that share a part. A row's key tells the shorter length, the edits, the part and its text."""
    spans = f"int(floor(m * {share}D + 1e-9D))"
    # k edits leave one of k + 1 parts as it is: part i of a name of length l stands from l * i div (k + 1)
    ks = own.withColumn("k", F.explode(F.expr(f"array_distinct(transform(sequence(n, n + d), m -> {spans}))"))).where("k > 0")
    part = "struct(i AS i, substr(x, int(n * i div (k + 1)) + 1, int(n * (i + 1) div (k + 1)) - int(n * i div (k + 1))) AS s)"
    short = ks.select("x", "n", "k", F.explode(F.expr(f"transform(sequence(0, k), i -> {part})")).alias("p"))
    left = short.select(F.xxhash64("n", "k", "p.i", "p.s").alias("g"), F.col("x").alias("s"), F.col("n").alias("ns"))
    k = F.expr(spans.replace("m *", "n *")).alias("k")
    lengths = own.select("x", "n", k).where("k > 0").select("x", "n", "k", F.explode(F.expr("sequence(greatest(1, n - k), n)")).alias("l"))
    each = lengths.select("x", "n", "k", "l", F.explode(F.expr("sequence(0, k)")).alias("i")).selectExpr("x", "n", "k", "l", "i", "int(l * i div (k + 1)) AS p", "int(l * (i + 1) div (k + 1)) - int(l * i div (k + 1)) AS w")
    # of k edits, those before the part move it one way and those after it make up for the rest of what the lengths differ by
    first, last = "greatest(0, p - (k - (n - l)) div 2)", "least(n - w, p + (k + (n - l)) div 2)"
    at = each.where(f"{first} <= {last}").select("x", "n", "k", "l", "i", "w", F.explode(F.expr(f"sequence(int({first}), int({last}))")).alias("at"))
    right = at.select(F.xxhash64("l", "k", "i", F.expr("substr(x, at + 1, w)")).alias("g"), F.col("x").alias("t"), F.col("n").alias("nt"))
    met = _paired(right.distinct(), left, "g", "t").where("s <> t")
    swap = F.col("s") < F.col("t")
    side = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    return met.select(side("s", "t").alias("a"), side("ns", "nt").alias("na"), side("t", "s").alias("b"), side("nt", "ns").alias("nb"))


def _by_grams(own: DataFrame) -> DataFrame:
    """``a, na, b, nb``: candidates that share one of their rarest grams."""
    each = own.withColumn("g", F.explode(F.array_distinct(F.expr(f"transform(sequence(1, greatest(1, n - {GRAM - 1})), i -> substr(x, i, {GRAM}))"))))
    often = each.groupBy("g").agg(F.count("*").alias("held"))
    rarest = Window.partitionBy("x").orderBy("held", "g")
    # a gram that stands twice counts once, so a name of few different grams is in all its blocks
    kept = each.join(often, "g").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= GRAM * F.col("d") + 1)
    left = kept.select("g", F.col("x").alias("a"), F.col("n").alias("na"))
    right = kept.select("g", F.col("x").alias("b"), F.col("n").alias("nb"))
    return _paired(left, right, "g", "a").where("a < b").select("a", "na", "b", "nb")
