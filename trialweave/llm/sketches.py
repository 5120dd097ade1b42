"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the sorted array of the ``k`` smallest 64-bit hashes of a text's distinct word
shingles.  Sketches of parts merge to the sketch of the whole; two sketches estimate the
resemblance and containment of their shingle sets, one the number of distinct shingles.
All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.filters import let

K = 128
WIDTH = 5


def sketch(text: Column, width: int = WIDTH, k: int = K) -> Column:
    """The bottom-k sketch of a text; null and texts without words have an empty one.

    Words are runs without ASCII white space.  A text with fewer words than ``width`` is one
    shingle.
    """

    def of_words(words: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(hashes) - width)
            several = F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width))))
            one = F.array(F.xxhash64(F.array_join(words, " ")))
            none = F.array().cast("array<bigint>")
            return F.when(F.size(hashes) >= width, several).when(F.size(hashes) > 0, one).otherwise(none)

        return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return bottom(let(words, of_words), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return bottom(F.concat(a, b), k)


def merge_all(rows: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """Sketches of groups of rows, merged: one row per group with ``column``.

    The smallest distinct hashes of each group are ranked within hash ranges first, so that a
    group of any size passes no more than ``k`` hashes of each range to its merge.
    """
    hashes = rows.select(*by, F.explode(column).alias("_h")).distinct()
    part = Window.partitionBy(*by, F.pmod("_h", F.lit(256))).orderBy("_h")
    low = hashes.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    return low.groupBy(*by).agg(bottom(F.collect_list("_h"), k).alias(column))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def _common(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """Size of the merged sketch, and how many of its hashes both sketches have."""
    both = let(merge(a, b, k), lambda u: F.struct(F.size(u).alias("n"), F.size(F.array_intersect(u, F.array_intersect(a, b))).alias("m")))
    return both["n"], both["m"]


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated intersection over union, from 0 to 1; two empty sets are alike."""
    total, common = _common(a, b, k)
    return F.coalesce(common.cast("double") / F.nullif(total, F.lit(0)), F.lit(1.0))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that lies in the second; an empty set is contained."""
    total, common = _common(a, b, k)
    whole = distinct_shingles(merge(a, b, k), k) * common / F.greatest(total, F.lit(1))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), whole / distinct_shingles(a, k)))


def shown(a: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, with commas."""
    return F.array_join(F.transform(a, lambda h: F.hex(h)), ",")


def with_next(rows: DataFrame, key: str, derived: dict[str, Column] | None = None, per_part: int = 500) -> DataFrame:
    """``rows`` with ``next``: a struct of the row that follows in descending order of the key.

    After the last row comes the first.  Keys are cut into ranges at approximate quantiles,
    which are keys of the data.  Each range's largest row is also given to the range above, so
    a window within a range sees every successor.  Equal keys follow in the order of the other
    columns' hash.  Null keys must have been replaced.  ``derived`` columns are computed after
    the shuffle, once per row, and are in ``next`` too.
    """
    ranges = min(20_000, rows.count() // per_part + 1)
    # ends of the ranges: approximate quantiles and the exact largest key
    step = [i / ranges for i in range(1, ranges)]
    quantiles = F.percentile_approx(key, F.array(*map(F.lit, step)), 20 * ranges) if step else F.array().cast("array<bigint>")
    found = rows.agg(quantiles.alias("q"), F.max(key).alias("top")).first()
    if found.top is None:
        return rows.withColumns(derived or {}).withColumn("next", F.struct(*rows.columns, *(derived or {}))).where("false")
    ends = sorted({*(found.q or []), found.top})
    group = int(len(ends) ** 0.5) + 1
    groups = [ends[i : i + group] for i in range(0, len(ends), group)]
    lasts, table = F.array(*(F.lit(g[-1]) for g in groups)), F.array(*(F.array(*map(F.lit, g)) for g in groups))
    outer = F.size(F.filter(lasts, lambda x: x < F.col(key)))
    inner = F.size(F.filter(F.get(table, outer), lambda x: x < F.col(key)))
    number = (outer * group + inner).cast("int")
    is_end = F.get(F.get(table, outer), inner) == F.col(key)
    beyond = F.when(number + 1 < len(ends), number + 1).otherwise(0)
    own = F.struct(number.alias("part"), F.lit(False).alias("guest"))
    places = F.when(is_end, F.array(own, F.struct(beyond.alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    placed = rows.withColumn("_place", F.explode(places)).select(*rows.columns, F.col("_place.part").alias("_part"), F.col("_place.guest").alias("_guest"))
    placed = placed.repartition("_part").withColumns(derived or {})
    columns = [c for c in placed.columns if c not in ("_part", "_guest")]
    window = Window.partitionBy("_part").orderBy("_guest", F.col(key).desc(), F.xxhash64(*rows.columns))
    placed = placed.withColumn("next", F.lead(F.struct(*columns)).over(window))
    return placed.where("not _guest").select(*columns, "next")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K) -> DataFrame:
    """``(key, sketch)`` of every whole text."""
    return docs.select(key, sketch(F.col(text), k=k).alias("sketch"))
