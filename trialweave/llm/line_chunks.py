"""Line dedup by content-defined chunks.

A text is cut into chunks of lines where a rolling hash over the hashes of ``window`` lines
meets a condition, so an insertion moves boundaries only near itself.  Chunks of several lines
that occur more than once in the corpus are compared by their bytes; every occurrence but the
first, by key and position, is removed.  Chunks of one line always stay: by the plain condition
a quarter of all lines, by the ``spaced`` one only texts of one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.filters import let, may_match, whole_key
from trialweave.sources.stages import stage


def line_hash(line: Column) -> Column:
    """32 bits of the line's MD5 as a number."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def chunks(text: Column, window: int = 2, divisor: int = 2, spaced: bool = False) -> Column:
    """Array of ``(idx, n_lines, body)``: the text's chunks in order.

    A chunk ends after a line when the rolling hash (base 31) of it and the lines before it,
    ``window`` in all, is a multiple of ``divisor``; the last chunk ends with the text.  With
    ``spaced`` a line does not end a chunk where the line before meets the condition too or
    only one line is left, so every chunk of a text of several lines has two or more.
    """

    def cut(lines: Column) -> Column:
        def ends(hashes: Column) -> Column:
            def meets(i: Column) -> Column:
                rolling = F.lit(0).cast("bigint")
                for j in range(window, 0, -1):
                    rolling = rolling * 31 + F.get(hashes, i - j)
                return F.when(i < window, False).otherwise(F.pmod(rolling, F.lit(divisor)) == 0)

            def is_end(i: Column) -> Column:
                inner = meets(i) & ~meets(i - 1) & (i < F.size(lines) - 1) if spaced else meets(i)
                return (i == F.size(lines)) | inner

            return F.filter(F.sequence(F.lit(1), F.size(lines)), is_end)

        def bodies(stops: Column) -> Column:
            def chunk(stop: Column, k: Column) -> Column:
                start = F.coalesce(F.get(stops, k - 1), F.lit(0))
                body = F.array_join(F.slice(lines, start + 1, stop - start), "\n")
                return F.struct(k.alias("idx"), (stop - start).alias("n_lines"), body.alias("body"))

            return F.transform(stops, chunk)

        return let(let(F.transform(lines, line_hash), ends), bodies)

    return let(F.split(text, "\n", -1), cut)


def remove_repeats(docs: DataFrame, window: int = 2, divisor: int = 2, text: str = "text", key: str = "doc_id", spaced: bool = False) -> DataFrame:
    """``docs`` with ``text`` shortened and two more columns, ``n_lines`` and ``n_removed``.

    Removed are chunks of two or more lines whose bytes occur earlier, in a row with a smaller
    key or further up in the same text; what is left is joined by line feeds.  A null text
    stays null with no lines; an empty one is one empty line.  A null key comes first.  Rows
    that share a key have equal rank, so none removes the other's chunk at the same position.
    Joins are by key at every size; what needs no join is sorted out before.
    Columns of ``docs`` called ``n_lines`` or ``n_removed`` are replaced.  The key is an
    integer.
    """
    docs = docs.drop("n_lines", "n_removed")
    rows = docs.select(whole_key(F.col(key)).alias("k"), F.xxhash64(text).alias("v"), F.col(text).alias("t")).where("t is not null")

    long = F.filter(chunks(F.col("t"), window, divisor, spaced), lambda c: c["n_lines"] > 1)
    hashed = F.transform(long, lambda c: F.struct(c["idx"].alias("idx"), F.xxhash64(c["body"]).alias("h")))
    hashed = rows.select("k", "v", F.explode(hashed).alias("c")).select("k", "v", "c.idx", "c.h")
    repeated = stage(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    suspects = hashed.join(repeated.hint("merge"), "h").groupBy("k", "v").agg(F.collect_set("idx").alias("at"))
    suspects = stage(suspects, "suspects")
    near = may_match(rows, "k", suspects, "near").where("near")
    parts = F.filter(chunks(F.col("t"), window, divisor, spaced), lambda c: F.array_contains("at", c["idx"]))
    bodies = near.join(suspects.hint("merge"), ["k", "v"]).select("k", "v", F.explode(parts).alias("c"))
    bodies = stage(bodies.select("k", "v", F.col("c.idx").alias("idx"), F.col("c.body").alias("body")), "bodies")
    first = bodies.groupBy("body").agg(F.count("*").alias("n"), F.min(F.struct("k", "idx")).alias("first")).where("n > 1")
    again = bodies.join(first.hint("merge"), "body").where(F.struct("k", "idx") != F.col("first"))
    gone = stage(again.groupBy("k", "v").agg(F.collect_set("idx").alias("gone")), "removals")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), whole_key(F.col(key)).alias("k"), F.xxhash64(text).alias("v"))
    keyed = may_match(keyed, "k", gone, "near")
    there = keyed.where("near").join(gone.hint("merge"), ["k", "v"], "left").select("row", "gone")
    both = there.unionAll(keyed.where("not near").select("row", F.lit(None).cast("array<int>").alias("gone")))
    before = F.col("row")[text]
    n_lines = F.when(before.isNull(), 0).otherwise(F.size(F.split(before, "\n", -1)))

    def shortened(parts: Column) -> Column:
        left = F.filter(parts, lambda c: ~F.array_contains("gone", c["idx"]))
        lost = F.filter(parts, lambda c: F.array_contains("gone", c["idx"]))
        count = F.aggregate(lost, F.lit(0), lambda total, c: total + c["n_lines"])
        return F.struct(F.array_join(F.transform(left, lambda c: c["body"]), "\n").alias("t"), count.alias("n"))

    done = F.when(F.col("gone").isNotNull(), let(chunks(before, window, divisor, spaced), shortened))
    both = both.select("row", n_lines.alias("n_lines"), done.alias("done"))
    after = {text: F.coalesce("done.t", before)}
    own = [after.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    return both.select(*own, "n_lines", F.coalesce("done.n", F.lit(0)).alias("n_removed"))
