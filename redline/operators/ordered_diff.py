"""Ordered line differences of many text pairs at once.

All pairs are compared together.  Equal lines of a pair meet in equi joins; the longest chain of
matches that rises on both sides is what the two texts keep, the other lines are removed or added.

A segment (at first a whole pair) with at most ``MAX_MATCHES`` matches is solved exactly: the chain is a
longest common subsequence.  A larger one is cut at the chain of the lines that are unique on both
sides, and the gaps are the segments of the next round; without unique lines, the k-th copies of a line
are matched with each other.  So repeated lines never make the product of their counts, every script
rebuilds both texts, and it is a shortest one unless a segment was cut.

Positions, context and numbering are windows within one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.session import materialize, ship_package

MAX_MATCHES = 100_000
CONTEXT = 3
PAIR = ["contract_id", "template_id"]
#: Line ends of str.splitlines.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def text_lines(text) -> Column:
    """The lines of a text, without an empty one after a final line end; null and empty: none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def longest_chain(i, j) -> list[int]:
    """Which matches form a longest chain rising in both i and j (patience piles with back links)."""
    from bisect import bisect_left
    order = sorted(range(len(i)), key=lambda m: (i[m], -j[m]))
    tops, piles, back = [], [], [-1] * len(i)
    for m in order:
        p = bisect_left(tops, j[m])
        back[m] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(j[m])
            piles.append(m)
        else:
            tops[p], piles[p] = j[m], m
    chain, m = [], piles[-1] if piles else -1
    while m >= 0:
        chain.append(m)
        m = back[m]
    return chain


def _chains(batches):
    """Rows (segment columns, matches) -> one row per match of the longest chain."""
    import pyarrow as pa
    for batch in batches:
        own, keep = [], []
        offsets, found = batch.column("m").offsets.to_pylist(), batch.column("m").values
        left, right = found.field("i").to_pylist(), found.field("j").to_pylist()
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            for m in longest_chain(left[a:b], right[a:b]):
                own.append(k)
                keep.append((left[a + m], right[a + m]))
        columns = [batch.column(c).take(pa.array(own, pa.int64())) for c in (*PAIR, "seg", "cut")]
        yield pa.RecordBatch.from_arrays(
            columns + [pa.array([x for x, _ in keep], pa.int32()), pa.array([y for _, y in keep], pa.int32())],
            names=[*PAIR, "seg", "cut", "i", "j"])


def matched_lines(lines: DataFrame, max_matches: int = MAX_MATCHES) -> DataFrame:
    """(contract_id, template_id, i, j): template line i is kept as contract line j.

    ``lines``: (contract_id, template_id, side t or c, pos, line)."""
    ship_package(lines.sparkSession)
    seg = [*PAIR, "seg"]
    left, done = lines.withColumn("seg", F.lit("")), []
    while True:
        left = materialize(left)
        counts = (left.groupBy(*seg, "line").agg(F.count_if(F.col("side") == "t").alias("nt"), F.count_if(F.col("side") == "c").alias("nc"))
                  .where("nt > 0 AND nc > 0").withColumn("single", F.expr("nt = 1 AND nc = 1")))
        segs = counts.groupBy(*seg).agg((F.sum(F.col("nt") * F.col("nc")) > max_matches).alias("large"), F.max("single").alias("any"))
        segs = segs.select(*seg, (F.col("large") & F.col("any")).alias("cut"), (F.col("large") & ~F.col("any")).alias("by_copy"))
        usable = counts.join(segs, seg).where("NOT cut OR single").select(*seg, "line", "cut", "by_copy")
        x = left.join(usable, [*seg, "line"])
        copy = F.row_number().over(Window.partitionBy(*seg, "line", "side").orderBy("pos"))
        x = x.withColumn("copy", F.when(F.col("by_copy"), copy).otherwise(0))
        on = [*seg, "line", "cut", "copy"]
        matches = (x.where("side = 't'").select(*on, F.col("pos").alias("i"))
                   .join(x.where("side = 'c'").select(*on, F.col("pos").alias("j")), on))
        grouped = matches.groupBy(*seg, "cut").agg(F.collect_list(F.struct("i", "j")).alias("m"))
        names = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in PAIR)
        chain = materialize(grouped.mapInArrow(_chains, f"{names}, seg string, cut boolean, i int, j int"))
        done.append(chain.select(*PAIR, "i", "j"))
        cuts = chain.where("cut")
        if cuts.isEmpty():
            break
        # The gaps of the cut segments: lines between the same two matches of the chain.
        ends = (cuts.select(*seg, F.lit("t").alias("side"), F.col("i").alias("pos"))
                .unionByName(cuts.select(*seg, F.lit("c").alias("side"), F.col("j").alias("pos"))).withColumn("end", F.lit(1)))
        rest = left.join(cuts.select(*seg).distinct(), seg, "left_semi").join(ends, [*seg, "side", "pos"], "left")
        before = Window.partitionBy(*seg, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        gap = F.sum(F.coalesce("end", F.lit(0))).over(before)
        left = (rest.withColumn("gap", gap).where("end IS NULL")
                .select(*PAIR, "side", "pos", "line", F.concat_ws(".", "seg", F.col("gap").cast("string")).alias("seg")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def edit_script(pairs: DataFrame, contracts: DataFrame, templates: DataFrame, max_matches: int = MAX_MATCHES) -> DataFrame:
    """(contract_id, template_id, seq, op, content): the lines of both texts of every pair in order; op is
    equal, removed (template only) or added (contract only).  Where both stand between the same kept
    lines, the removed ones come first."""
    p = pairs.where(F.col("template_id").isNotNull()).select(*PAIR).distinct()
    t = templates.select(F.col("id").alias("template_id"), F.posexplode(text_lines("content")).alias("pos", "line"))
    c = contracts.select(F.col("id").alias("contract_id"), F.posexplode(text_lines("extracted_text")).alias("pos", "line"))
    lines = materialize(p.join(t, "template_id").select(*PAIR, F.lit("t").alias("side"), "pos", "line")
                        .unionByName(p.join(c, "contract_id").select(*PAIR, F.lit("c").alias("side"), "pos", "line")))
    kept = matched_lines(lines, max_matches)
    marks = (kept.select(*PAIR, F.lit("t").alias("side"), F.col("i").alias("pos"))
             .unionByName(kept.select(*PAIR, F.lit("c").alias("side"), F.col("j").alias("pos"))).withColumn("keep", F.lit(1)))
    x = lines.join(marks, [*PAIR, "side", "pos"], "left")
    # A line's place: the kept lines before it, then removed, added, and the kept line itself.
    before = Window.partitionBy(*PAIR, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("gap", F.coalesce(F.sum(F.coalesce("keep", F.lit(0))).over(before), F.lit(0)))
    x = x.where("keep IS NULL OR side = 't'")
    op = F.when(F.col("keep") == 1, "equal").when(F.col("side") == "t", "removed").otherwise("added")
    kind = F.when(F.col("keep") == 1, 2).when(F.col("side") == "t", 0).otherwise(1)
    place = Window.partitionBy(*PAIR).orderBy("gap", kind, "pos")
    return x.select(*PAIR, (F.row_number().over(place) - 1).alias("seq"), op.alias("op"), F.col("line").alias("content"))


def template_diff(script: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(contract_id, template_id, line_number, type, content, context): the differences of edit scripts.

    ``line_number`` counts the lines that a unified listing shows, differences and up to ``context`` equal
    lines before and after them; equal lines further away are skipped.  A removed line that begins with
    ``--`` and an added one with ``++`` read as headers there: they are neither listed nor counted."""
    change = F.when(F.col("op") != "equal", F.col("seq"))
    w = Window.partitionBy(*PAIR).orderBy("seq")
    last = F.last(change, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(change, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = (F.col("seq") - F.col("last") <= context) | (F.col("next") - F.col("seq") <= context)
    header = ((F.col("op") == "removed") & F.col("content").startswith("--")) | ((F.col("op") == "added") & F.col("content").startswith("++"))
    shown = script.withColumn("last", last).withColumn("next", following).where(near & ~header)
    numbered = shown.withColumn("line_number", (F.row_number().over(w) - 1).cast("bigint")).where("op <> 'equal'")
    return numbered.select(*PAIR, "line_number", F.col("op").alias("type"), "content",
                           F.when(F.col("op") == "removed", "template").otherwise("contract").alias("context"))


def hunks(script: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(contract_id, template_id, hunk, first_seq, last_seq, n_removed, n_added): islands of shown lines.
    Differences whose context windows touch share a hunk."""
    w = Window.partitionBy(*PAIR).orderBy("seq")
    gap = F.col("seq") - F.lag("seq").over(w)
    changes = script.where("op <> 'equal'").withColumn("opens", (F.coalesce(gap, F.lit(1 << 30)) > 2 * context + 1).cast("int"))
    island = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    size = script.groupBy(*PAIR).agg(F.max("seq").alias("end"))
    g = changes.withColumn("hunk", island).groupBy(*PAIR, "hunk").agg(
        F.min("seq").alias("a"), F.max("seq").alias("b"), F.count_if(F.col("op") == "removed").alias("n_removed"),
        F.count_if(F.col("op") == "added").alias("n_added"))
    return g.join(size, PAIR).select(*PAIR, F.col("hunk").cast("bigint").alias("hunk"), F.greatest(F.col("a") - context, F.lit(0)).alias("first_seq"),
                                     F.least(F.col("b") + context, F.col("end")).alias("last_seq"), "n_removed", "n_added")


def diff_by_line(diffs: DataFrame, limit: int = 100) -> DataFrame:
    """(contract_id, template_id, line_number, removed, added): the differences of a line number, of each
    pair's first ``limit`` numbers."""
    g = diffs.groupBy(*PAIR, "line_number").agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "removed", F.col("content")))).alias("removed"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "added", F.col("content")))).alias("added"))
    rank = F.row_number().over(Window.partitionBy(*PAIR).orderBy("line_number"))
    return g.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
