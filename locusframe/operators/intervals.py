"""Interval algebra on half-open, 0-based ``[start_pos, end_pos)`` rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.scans import TILE_BITS, prefix_scan
from locusframe.session import cut_lineage

KEYS = ("seqid",)
BIN_BITS = 14  # 16 kb: about the length of a long gene


# --- neighbour facts -------------------------------------------------------

def orientation(left: Column, right: Column) -> Column:
    """Orientation class of the two strands that face each other over a gap."""
    known = left.isin("+", "-") & right.isin("+", "-")
    return (
        F.when(~known, "unknown")
        .when(left == right, "tandem")
        .when(left == "+", "convergent")
        .otherwise("divergent")
    )


def _edge_facts(confidence: str) -> list[Column]:
    """Facts about all entities that share one edge; all combine map-side."""
    return [
        F.bool_or(F.col("strand") == "+").alias("has_plus"),
        F.bool_or(F.col("strand") == "-").alias("has_minus"),
        F.bool_and(F.col(confidence) == "high").alias("all_high"),
        F.bool_or(F.col(confidence) == "uncertain").alias("any_uncertain"),
    ]


def _edge_strand() -> Column:
    plus, minus = F.col("has_plus"), F.col("has_minus")
    return F.when(plus & ~minus, "+").when(minus & ~plus, "-").otherwise(".")


def _edge_confidence() -> Column:
    return (
        F.when(F.col("all_high"), "high")
        .when(F.col("any_uncertain"), "uncertain")
        .otherwise("unknown")
    )


def _islands(entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per distinct start, numbered by the merged cluster it falls in.

    Entities with one start collapse first (map-side), so a pile of copies
    costs one row.  A start opens a cluster unless it lies strictly before the
    largest end seen so far: touching intervals stay apart.
    """
    starts = entities.groupBy(*keys, "start_pos").agg(F.max("end_pos").alias("max_end"))
    reached = prefix_scan(starts, keys, "start_pos", {"prev_end": ("max", "max_end")})
    opened = reached.withColumn(
        "opens",
        (F.col("prev_end").isNull() | (F.col("start_pos") >= F.col("prev_end"))).cast("int"),
    )
    return (
        prefix_scan(opened, keys, "start_pos", {"opened_before": ("sum", "opens")})
        .withColumn("cluster_no", F.col("opened_before") + F.col("opens"))
    )


def _edges(entities: DataFrame, keys: Sequence[str], edge: str, side: str) -> DataFrame:
    """Representative strand and confidence of all entities on one edge."""
    return (
        entities.groupBy(*keys, f"{edge}_pos")
        .agg(*_edge_facts(f"{edge}_conf"))
        .select(
            *keys,
            f"{edge}_pos",
            _edge_strand().alias(f"{side}_strand"),
            _edge_confidence().alias(f"{side}_confidence"),
        )
    )


def cluster_spans(entities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, cluster_no, start_pos, end_pos`` of the merged clusters."""
    return _islands(entities, list(keys)).groupBy(*keys, "cluster_no").agg(
        F.min("start_pos").alias("start_pos"), F.max("max_end").alias("end_pos"))


def merge_clusters(entities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Merge overlapping entities; columns describe the two outer edges.

    ``entities`` needs ``keys, start_pos, end_pos, strand, start_conf,
    end_conf``.  ``cluster_no`` counts from 1 along each sequence.
    """
    keys = list(keys)
    return (
        cluster_spans(entities, keys)
        .join(_edges(entities, keys, "start", "left"), [*keys, "start_pos"])
        .join(_edges(entities, keys, "end", "right"), [*keys, "end_pos"])
        .select(
            *keys, "cluster_no", "start_pos", "end_pos",
            "left_strand", "right_strand", "left_confidence", "right_confidence",
        )
    )


def cluster_members(entities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, entity_id, cluster_no`` in long form."""
    keys = list(keys)
    numbered = _islands(entities, keys).select(*keys, "start_pos", "cluster_no")
    return entities.join(numbered, [*keys, "start_pos"]).select(*keys, "entity_id", "cluster_no")


def gap_spans(entities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, region_no, start_pos, end_pos`` of the gaps between clusters.

    ``region_no`` is the ordinal of the cluster *pair*, so a touching pair
    leaves a hole in the numbering.
    """
    return (
        _islands(entities, list(keys))
        .where((F.col("opens") == 1) & (F.col("prev_end") < F.col("start_pos")))
        .select(
            *keys,
            (F.col("cluster_no") - 1).alias("region_no"),
            F.col("prev_end").alias("gap_start"),
            F.col("start_pos").alias("gap_end"),
        )
        .withColumnsRenamed({"gap_start": "start_pos", "gap_end": "end_pos"})
    )


#: What is known of the entities that end last: the largest end of those with a property.
_ENDS = {
    "end": None, "plus": ("strand", "+"), "minus": ("strand", "-"), "high": ("end_conf", "high"), "uncertain": ("end_conf", "uncertain"),
}


_FACTS = ("has_plus", "has_minus", "all_high", "any_uncertain")


def gaps(entities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every gap between consecutive clusters, with the facts of both sides.

    One scan over the distinct starts carries everything the left side of a
    gap needs: entities with a property share the left edge exactly if the
    largest end of all those with it is the largest end of all.  The right
    side is known where the starts collapse; its four facts ride in the low
    bits of the largest end, so that both passes of the scan need the same
    columns and share one exchange.  Only cluster openings are written and
    numbered.
    """
    keys = list(keys)
    end = F.col("end_pos")
    ends = [F.max(end if test is None else F.when(F.col(test[0]) == test[1], end)).alias(f"{name}_end") for name, test in _ENDS.items()]
    ends.append(F.max(F.when(F.col("end_conf") != "high", end)).alias("lower_end"))
    packed = F.coalesce("end_end", F.lit(-1)).cast("bigint") * 16
    for bit, fact in enumerate(_FACTS):
        packed = packed + F.when(F.col(fact), 1 << bit).otherwise(0)
    others = [f"{name}_end" for name in (*_ENDS, "lower") if name != "end"]
    starts = entities.groupBy(*keys, "start_pos").agg(*ends, *_edge_facts("start_conf")).select(
        *keys, "start_pos", packed.alias("end_end"), *others)
    facts = {fact: F.col("end_end").bitwiseAND(F.lit(1 << bit)) != 0 for bit, fact in enumerate(_FACTS)}
    seen = prefix_scan(starts, keys, "start_pos", {
        f"{name}_before": ("max", f"{name}_end") for name in (*_ENDS, "lower")}).withColumns(
        {"end_before": F.nullif(F.shiftright("end_before", 4), F.lit(-1).cast("bigint"))} | facts)
    last = F.col("end_before")
    on_edge = {name: F.coalesce(F.col(f"{name}_before") == last, F.lit(False)) for name in (*_ENDS, "lower")}
    opened = cut_lineage(seen.where(last.isNull() | (F.col("start_pos") >= last)).select(
        *keys, "start_pos", last.alias("prev_end"), F.lit(1).alias("opens"),
        F.when(on_edge["plus"] & ~on_edge["minus"], "+").when(on_edge["minus"] & ~on_edge["plus"], "-").otherwise(".").alias("left_strand"),
        F.when(on_edge["high"] & ~on_edge["lower"], "high").when(on_edge["uncertain"], "uncertain").otherwise("unknown").alias("left_confidence"),
        _edge_strand().alias("right_strand"), _edge_confidence().alias("right_confidence")))
    numbered = prefix_scan(opened, keys, "start_pos", {"region_no": ("sum", "opens")})
    return numbered.where("prev_end < start_pos").select(
        *keys, "region_no", F.col("prev_end").alias("start_pos"), F.col("start_pos").alias("end_pos"),
        "left_strand", "right_strand", "left_confidence", "right_confidence",
    ).select(
        *keys,
        "region_no",
        region_id("intergenic").alias("region_id"),
        "start_pos",
        "end_pos",
        (F.col("end_pos") - F.col("start_pos")).alias("length"),
        "left_strand",
        "right_strand",
        orientation(F.col("left_strand"), F.col("right_strand")).alias("orientation"),
        "left_confidence",
        "right_confidence",
    )


def region_id(kind: str) -> Column:
    return F.format_string(f"%s:{kind}:%06d", F.col("seqid"), F.col("region_no"))


def gap_neighbours(
    regions: DataFrame, entities: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Entities at the two edges of every gap, one row each.

    A neighbour is an entity whose own end (start) is the edge, so the lookup
    is an equality join on the coordinate and spreads over all positions.
    """
    keys = list(keys)
    left = regions.select(*keys, "region_id", F.col("start_pos").alias("end_pos"))
    right = regions.select(*keys, "region_id", F.col("end_pos").alias("start_pos"))
    ids = [*keys, "region_id", "side", "entity_id", "strand", "confidence"]
    return (
        entities.join(left, [*keys, "end_pos"])
        .withColumn("side", F.lit("left"))
        .withColumn("confidence", F.col("end_conf"))
        .select(*ids)
        .unionByName(
            entities.join(right, [*keys, "start_pos"])
            .withColumn("side", F.lit("right"))
            .withColumn("confidence", F.col("start_conf"))
            .select(*ids)
        )
    )


def pack_neighbours(neighbours: DataFrame, limit: int = 1000) -> DataFrame:
    """``region_id, part, left_ids, right_ids`` arrays for row-shaped exports.

    Part 0 of a region has its first ``limit`` ids of each side, part 1 the
    next, and so on: every id is in some part, and no cell outgrows the limit.
    """
    order = Window.partitionBy("region_id", "side").orderBy("entity_id")
    placed = neighbours.withColumn("part", F.floor((F.row_number().over(order) - 1) / limit).cast("int"))

    def ids(side: str):
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("entity_id")))).alias(f"{side}_ids")

    return placed.groupBy("region_id", "part").agg(ids("left"), ids("right"))


# --- sequence ends ---------------------------------------------------------

def terminals(
    entities: DataFrame, sequences: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Regions between a sequence end and its first or last cluster.

    ``sequences`` holds only the sequences to report on, with ``length`` and,
    for ``five_prime`` and ``three_prime``, a status column and the columns
    ``*_evidence`` and ``*_declaration``.  A sequence without entities gives
    one row for its whole length.
    """
    keys = list(keys)
    spans = entities.groupBy(*keys).agg(
        F.min("start_pos").alias("first_start"), F.max("end_pos").alias("last_end")
    )
    five, three = F.col("five_prime"), F.col("three_prime")

    def joined(suffix: str) -> Column:
        return F.concat(
            F.lit("5p: "), F.col(f"five_prime_{suffix}"),
            F.lit(" | 3p: "), F.col(f"three_prime_{suffix}"),
        )

    def row(side, name, start, end, adjacent, status, evidence, declaration, true_end):
        return F.struct(
            F.concat(F.col("seqid"), F.lit(f":{name}")).alias("region_id"),
            start.cast("bigint").alias("start_pos"),
            end.cast("bigint").alias("end_pos"),
            F.lit(side).alias("side"),
            F.lit(adjacent).alias("adjacent_sequence_end"),
            status.alias("adjacent_end_status"),
            evidence.alias("adjacent_end_evidence"),
            declaration.alias("adjacent_end_declaration"),
            true_end.alias("true_telomere_distance"),
        )

    covered = F.col("first_start").isNotNull()
    whole = row(
        "whole_sequence_no_features", "whole-sequence", F.lit(0), F.col("length"), "both",
        F.when(five == three, five).otherwise("unknown"),
        joined("evidence"), joined("declaration"),
        (five == "complete") & (three == "complete"),
    )
    head = row(
        "5p", "5p-terminal", F.lit(0), F.col("first_start"), "5p", five,
        F.col("five_prime_evidence"), F.col("five_prime_declaration"), five == "complete",
    )
    tail = row(
        "3p", "3p-terminal", F.col("last_end"), F.col("length"), "3p", three,
        F.col("three_prime_evidence"), F.col("three_prime_declaration"), three == "complete",
    )
    candidates = F.array(
        F.when(~covered, whole),
        F.when(covered & (F.col("first_start") > 0), head),
        F.when(covered & (F.col("last_end") < F.col("length")), tail),
    )
    return (
        sequences.join(spans, keys, "left")
        .select(*keys, "five_prime", "three_prime", F.explode(F.array_compact(candidates)).alias("r"))
        .select(
            *keys,
            "r.region_id",
            "r.start_pos",
            "r.end_pos",
            (F.col("r.end_pos") - F.col("r.start_pos")).alias("length"),
            "r.side",
            "five_prime",
            "three_prime",
            "r.adjacent_sequence_end",
            "r.adjacent_end_status",
            "r.adjacent_end_evidence",
            "r.adjacent_end_declaration",
            "r.true_telomere_distance",
        )
    )


def terminal_neighbours(
    regions: DataFrame, entities: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Entities at the inner edge of each 5' or 3' terminal region."""
    keys = list(keys)
    head = regions.where("side = '5p'").select(
        *keys, "region_id", F.col("end_pos").alias("start_pos"))
    tail = regions.where("side = '3p'").select(
        *keys, "region_id", F.col("start_pos").alias("end_pos"))
    return (
        entities.join(head, [*keys, "start_pos"]).select(*keys, "region_id", "entity_id")
        .unionByName(entities.join(tail, [*keys, "end_pos"]).select(*keys, "region_id", "entity_id"))
    )


def conservation(
    entities: DataFrame, sequences: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Covered + gap + terminal bases against the length of each sequence."""
    keys = list(keys)

    def bases(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("part"),
                         (F.col("end_pos") - F.col("start_pos")).alias("bp"))

    parts = (
        bases(cluster_spans(entities, keys), "covered")
        .unionByName(bases(gap_spans(entities, keys), "gap"))
        .unionByName(bases(terminals(entities, sequences, keys), "terminal"))
    )
    sums = parts.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col("part") == p, F.col("bp"))), F.lit(0)).alias(f"{p}_bp")
        for p in ("covered", "gap", "terminal")
    ])
    total = F.col("covered_bp") + F.col("gap_bp") + F.col("terminal_bp")
    return sequences.select(*keys, "length").join(sums, keys).select(
        *keys, "length", "covered_bp", "gap_bp", "terminal_bp",
        (total == F.col("length")).alias("conserved"))


# --- overlap ---------------------------------------------------------------

def _with_bins(df: DataFrame, start: str, end: str, bits: int) -> DataFrame:
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn(
        "__bin", F.explode(F.sequence(F.shiftright(start, bits), F.shiftright(last, bits))))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str] = ("start_pos", "end_pos"),
    right_span: tuple[str, str] = ("cut_start", "cut_end"),
    bits: int = BIN_BITS,
) -> DataFrame:
    """Pairs of rows whose intervals overlap.

    Both sides are replicated to the fixed-width bins they touch and joined on
    equality of (keys, bin); a pair is kept in the bin of the later start only,
    so no ``distinct`` is needed.  Hot bins are split by the adaptive skew join.
    """
    keys = list(keys)
    (ls, le), (rs, re) = left_span, right_span
    pairs = _with_bins(left, ls, le, bits).join(
        _with_bins(right, rs, re, bits), [*keys, "__bin"])
    return pairs.where(
        (F.col(rs) < F.col(le))
        & (F.col(re) > F.col(ls))
        & (F.col("__bin") == F.shiftright(F.greatest(F.col(ls), F.col(rs)), bits))
    ).drop("__bin")


def start_in_interval(
    left: DataFrame, points: DataFrame, keys: Sequence[str], point: str,
    bits: int = BIN_BITS,
) -> DataFrame:
    """Join each point to the intervals that hold it; points need one bin only."""
    keys = list(keys)
    located = points.withColumn("__bin", F.shiftright(point, bits))
    return (
        _with_bins(left, "start_pos", "end_pos", bits)
        .join(located, [*keys, "__bin"])
        .where((F.col(point) >= F.col("start_pos")) & (F.col(point) < F.col("end_pos")))
        .drop("__bin")
    )


def overlapping_entities(
    entities: DataFrame, keys: Sequence[str] = KEYS, bits: int = BIN_BITS
) -> DataFrame:
    """Overlapping or nested entity pairs, the earlier one on the left.

    The right member starts inside the left one, so only the left side is
    replicated to bins.
    """
    keys = list(keys)
    later = entities.select(
        *keys,
        F.col("entity_id").alias("right_id"),
        F.col("start_pos").alias("right_start"),
        F.col("end_pos").alias("right_end"),
    )
    left = entities.select(*keys, "entity_id", "start_pos", "end_pos")
    pairs = start_in_interval(left, later, keys, "right_start", bits)
    earlier = F.struct("start_pos", "end_pos", "entity_id") < F.struct(
        F.col("right_start").alias("start_pos"),
        F.col("right_end").alias("end_pos"),
        F.col("right_id").alias("entity_id"),
    )
    return pairs.where(earlier).select(
        *keys,
        F.when(F.col("right_end") <= F.col("end_pos"), "nested").otherwise("overlaps").alias("kind"),
        F.col("entity_id").alias("left_id"),
        "right_id",
        F.col("right_start").alias("intersection_start"),
        F.least("end_pos", "right_end").alias("intersection_end"),
    )


def overlapping_spans(entities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The pairs of :func:`overlapping_entities`, one row for all of the same two spans.

    A span goes by the smallest id of the entities on it; ``n`` counts the
    pairs of entities.  Those on one span pair with each other: a row with
    that id on both sides.  Bins are about as wide as the mean span is long,
    so a span takes three bins in the mean, and the spans that meet in a bin
    are about those that overlap.
    """
    keys = list(keys)
    span = [*keys, "start_pos", "end_pos"]
    named = entities.groupBy(*span, "entity_id").agg(F.count(F.lit(1)).alias("records"))
    records = F.col("records")
    spans = cut_lineage(named.groupBy(*span).agg(
        F.min("entity_id").alias("entity_id"), F.sum(records).alias("weight"),
        F.sum(records * records).alias("squares")))
    mean = spans.agg(F.avg(F.col("end_pos") - F.col("start_pos"))).first()[0]
    bits = max(1, round(math.log2(max(mean or 1, 2))))
    known = spans
    for column in span:
        known = known.where(F.col(column).isNotNull())
    own = known.where((F.col("start_pos") < F.col("end_pos")) & (F.col("weight") * F.col("weight") > F.col("squares"))).select(
        *keys, F.lit("nested").alias("kind"), F.col("entity_id").alias("left_id"), F.col("entity_id").alias("right_id"),
        F.col("start_pos").alias("intersection_start"), F.col("end_pos").alias("intersection_end"),
        F.expr("(weight * weight - squares) div 2").alias("n"))
    later = known.select(
        *keys, F.col("entity_id").alias("right_id"), F.col("start_pos").alias("right_start"),
        F.col("end_pos").alias("right_end"), F.col("weight").alias("right_weight"))
    pairs = start_in_interval(known.drop("squares"), later, keys, "right_start", bits)
    earlier = F.struct("start_pos", "end_pos") < F.struct(
        F.col("right_start").alias("start_pos"), F.col("right_end").alias("end_pos"))
    return pairs.where(earlier).select(
        *keys,
        F.when(F.col("right_end") <= F.col("end_pos"), "nested").otherwise("overlaps").alias("kind"),
        F.col("entity_id").alias("left_id"), "right_id",
        F.col("right_start").alias("intersection_start"),
        F.least("end_pos", "right_end").alias("intersection_end"),
        (F.col("weight") * F.col("right_weight")).alias("n"),
    ).unionByName(own)


def _nested(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``keys, start_pos, reach`` that hold, or lie in, a row of another start: ``outer`` and ``inner``.

    The largest reach before and the smallest behind a start tell; both come
    from the tiles before and behind, which combine map-side, and from inside a tile.
    """
    tile = [*keys, "__tile"]
    tiled = spans.withColumn("__tile", F.shiftright(F.floor("start_pos"), TILE_BITS - 3))
    before = Window.partitionBy(*keys).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.desc("__tile")).rowsBetween(Window.unboundedPreceding, -1)
    carried = tiled.groupBy(*tile).agg(F.max("reach").alias("far"), F.min("reach").alias("near")).select(
        *tile, F.max("far").over(before).alias("far_before"), F.min("near").over(behind).alias("near_behind"))
    earlier = Window.partitionBy(*tile).orderBy("start_pos").rangeBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*tile).orderBy(F.desc("start_pos")).rangeBetween(Window.unboundedPreceding, -1)
    return tiled.join(carried, tile).withColumns({
        "inner": F.coalesce(F.greatest("far_before", F.max("reach").over(earlier)) >= F.col("reach"), F.lit(False)),
        "outer": F.coalesce(F.least("near_behind", F.min("reach").over(later)) <= F.col("reach"), F.lit(False)),
    }).where("inner OR outer").drop("far_before", "near_behind", "__tile")


def overlap_pair_counts(
    entities: DataFrame, keys: Sequence[str] = KEYS, digit_bits: int = 3
) -> DataFrame:
    """``keys, kind, n``: how many pairs ``overlapping_entities`` has, without making any.

    Equal intervals collapse to weights first.  All overlaps of a later member
    are the members before it less those that end before it starts, which
    prefix sums over positions give.  Nested pairs of different starts are a
    dominance count: two starts part at exactly one digit of their common
    length, so within the starts that agree above that digit, every later
    digit meets the ends of the earlier digits that reach at least as far.
    Only rows that are in such a pair, and the digits where they can be, move.
    Work grows with the distinct intervals and the digits of an axis, not with
    the depth of overlap.
    """
    keys = list(keys)
    known = entities.select(*keys, "entity_id", "start_pos", "end_pos").dropna(subset=[*keys, "start_pos", "end_pos"])
    spans = cut_lineage(
        known.groupBy(*keys, "start_pos", "end_pos", "entity_id").agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*keys, "start_pos", "end_pos").agg(
            F.sum("c").alias("w"), F.sum(F.col("c") * F.col("c")).alias("same")))
    wide = F.col("end_pos") > F.col("start_pos")
    weight, none = F.when(wide, F.col("w")).otherwise(F.lit(0)), F.lit(0).cast("bigint")
    events = spans.select(*keys, F.explode(F.array(
        F.struct(F.col("start_pos").cast("bigint").alias("pos"), weight.alias("begun"), (F.col("w") - weight).alias("points"), none.alias("ended")),
        F.struct(F.col("end_pos").cast("bigint").alias("pos"), none.alias("begun"), none.alias("points"), weight.alias("ended")),
    )).alias("e")).select(*keys, "e.*").groupBy(*keys, "pos").agg(
        *[F.sum(c).alias(c) for c in ("begun", "points", "ended")])
    # Both passes of the scan need all columns, so they share one exchange.
    scanned = prefix_scan(events, keys, "pos", {
        "ended_before": ("sum", "ended"), "points_before": ("sum", "points"), "members": ("total", "begun")})

    def big(column: Column) -> Column:
        return F.sum(column.cast("decimal(38,0)"))

    gone = F.col("ended_before") + F.col("ended")
    sums = scanned.groupBy(*keys).agg(
        F.max("members").cast("decimal(19,0)").alias("members"),
        big(F.col("begun") * gone).alias("apart"),
        big(F.col("ended") * F.col("points_before") - F.col("begun") * (F.col("points_before") + F.col("points"))).alias("inside"))
    same = spans.groupBy(*keys).agg(
        big(F.when(wide, F.col("same")).otherwise(0)).alias("selves"),
        big(F.when(wide, (F.col("w") * F.col("w") - F.col("same")) / 2).otherwise(0)).alias("equal"))

    # An interval without length lies inside what ends behind it.
    reach = F.greatest(F.col("end_pos"), F.col("start_pos") + 1).cast("bigint")
    last, widest = spans.agg(F.max("start_pos"), F.max(reach - F.col("start_pos"))).first()
    digits, count = 1 << digit_bits, max(1, -(-int(last or 0).bit_length() // digit_bits))
    # Few rows are in a nested pair at all, and these part at few digits: the outer one
    # where it goes past its block of starts, the inner one near the start of its block.
    level = F.sequence(F.lit(0), F.lit(count - 1))
    placed = _nested(spans.select(*keys, reach.alias("reach"), "w", "start_pos"), keys).select(
        *keys, "reach", "w", "start_pos", F.explode(F.filter(level, lambda at: (
            F.col("outer") & (F.col("reach") > F.call_function("shiftleft", F.call_function(
                "shiftright", F.col("start_pos").cast("bigint"), at * digit_bits) + 1, at * digit_bits))
        ) | (
            F.col("inner") & (F.col("reach") - int(widest or 0) < F.call_function("shiftleft", F.call_function(
                "shiftright", F.col("start_pos").cast("bigint"), at * digit_bits), at * digit_bits))
        ))).alias("level"))
    shift = F.col("level") * digit_bits
    at = F.call_function("shiftright", F.col("start_pos"), shift)
    dealt = placed.select(
        *keys, "level", F.call_function("shiftright", F.col("start_pos"), shift + digit_bits).alias("above"), "reach",
        at.bitwiseAND(F.lit(digits - 1)).alias("digit"), "w")
    group = [*keys, "level", "above"]
    # Starts that agree down to a digit alone meet nothing there.
    mixed = dealt.groupBy(*group, "reach").agg(*[
        F.sum(F.when(F.col("digit") == k, F.col("w")).otherwise(0)).alias(f"d{k}") for k in range(digits)])
    outputs = {f"p{k}": ("sum", f"d{k}") for k in range(digits - 1)} | {f"t{k}": ("total", f"d{k}") for k in range(digits - 1)}
    ranked = prefix_scan(mixed, group, "reach", outputs)
    met, earlier = F.lit(0).cast("decimal(38,0)"), F.lit(0)
    for k in range(1, digits):
        earlier = earlier + F.col(f"t{k - 1}") - F.col(f"p{k - 1}")
        met = met + F.col(f"d{k}") * earlier
    crossed = ranked.groupBy(*keys).agg(big(met).alias("crossed"))
    counted = sums.join(same, keys).join(crossed, keys, "left").select(
        *keys, (F.col("equal") + F.coalesce("crossed", F.lit(0))).alias("nested"),
        ((F.col("members") * F.col("members") - F.col("selves")) / 2 - F.col("apart") + F.col("inside")).alias("pairs"))
    return counted.select(*keys, F.explode(F.array(
        F.struct(F.lit("nested").alias("kind"), F.col("nested").cast("bigint").alias("n")),
        F.struct(F.lit("overlaps").alias("kind"), (F.col("pairs") - F.col("nested")).cast("bigint").alias("n")),
    )).alias("x")).select(*keys, "x.*").where("n > 0")


# --- subtraction -----------------------------------------------------------

def subtract_cuts(cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What remains of each span after its clipped cuts are removed.

    ``cuts`` carries, per cut, the span it belongs to (``keys``, ``span_start``,
    ``span_end``) and the clipped ``cut_start``/``cut_end``.  Cuts may overlap
    and come in any order; touching cuts leave nothing between them.  Cuts of
    one start collapse first, then a tiled running maximum finds the holes.
    """
    keys = list(keys)
    spans = [*keys, "span_start", "span_end"]
    starts = cuts.where("cut_end > cut_start").groupBy(*spans, "cut_start").agg(
        F.max("cut_end").alias("cut_end"))
    seen = prefix_scan(starts, spans, "cut_start", {"prev_end": ("max", "cut_end")})
    holes = seen.select(
        *spans,
        F.coalesce("prev_end", "span_start").alias("start_pos"),
        F.col("cut_start").alias("end_pos"),
    )
    tails = cuts.groupBy(*spans).agg(
        F.coalesce(F.max(F.when(F.expr("cut_end > cut_start"), F.col("cut_end"))),
                   F.col("span_start")).alias("start_pos"),
    ).select(*spans, "start_pos", F.col("span_end").alias("end_pos"))
    return holes.unionByName(tails).where("end_pos > start_pos")


def subtract(
    spans: DataFrame, cuts: DataFrame, keys: Sequence[str] = KEYS, span_keys: Sequence[str] = (),
    bits: int = BIN_BITS,
) -> DataFrame:
    """Interval subtraction of ``cuts`` from ``spans`` on the same sequence.

    ``span_keys`` names further columns that identify a span.  Spans without
    any overlapping cut come back unchanged.
    """
    keys, span_keys = list(keys), list(span_keys)
    spans = spans.where("end_pos > start_pos").select(*keys, *span_keys, "start_pos", "end_pos")
    renamed = cuts.select(
        *keys, F.col("start_pos").alias("cut_start"), F.col("end_pos").alias("cut_end"))
    hit = overlap_join(spans, renamed, keys, bits=bits).select(
        *keys,
        *span_keys,
        F.col("start_pos").alias("span_start"),
        F.col("end_pos").alias("span_end"),
        F.greatest("start_pos", "cut_start").alias("cut_start"),
        F.least("end_pos", "cut_end").alias("cut_end"),
    )
    touched = hit.select(
        *keys, *span_keys, F.col("span_start").alias("start_pos"), F.col("span_end").alias("end_pos"))
    whole = spans.join(touched, [*keys, *span_keys, "start_pos", "end_pos"], "left_anti")
    pieces = subtract_cuts(hit, [*keys, *span_keys])
    columns = [*keys, *span_keys, "start_pos", "end_pos"]
    return whole.select(*columns).unionByName(pieces.select(*columns))


# --- fixed windows and bins ------------------------------------------------

def fixed_windows(sequences: DataFrame, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Start, middle and end window of every sequence, clipped to its length."""
    length, half = F.col("length"), width // 2
    middle = F.floor(length / 2)

    def window(name: str, start: Column, end: Column) -> Column:
        return F.struct(
            F.lit(name).alias("window"),
            start.cast("bigint").alias("start_pos"),
            end.cast("bigint").alias("end_pos"),
        )

    rows = F.array(
        window("start", F.lit(0), F.least(length, F.lit(width))),
        window("middle", F.greatest(F.lit(0), middle - half), F.least(length, middle + half)),
        window("end", F.greatest(F.lit(0), length - width), length),
    )
    return sequences.select(*keys, "length", F.explode(rows).alias("w")).select(
        *keys, "length", "w.window", "w.start_pos", "w.end_pos")


def endpoint_proximity(
    rows: DataFrame, sequences: DataFrame, distance: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Tag rows within ``distance`` of an incomplete sequence end, 5' first."""
    ends = sequences.select(*keys, "length", "five_prime", "three_prime")
    near_five = (F.col("start_pos") < distance) & (F.col("five_prime") != "complete")
    near_three = (F.col("length") - F.col("end_pos") < distance) & (
        F.col("three_prime") != "complete")
    return rows.join(ends, list(keys)).withColumns({
        "endpoint_side": F.when(near_five, "five_prime").when(near_three, "three_prime"),
        "endpoint_status": F.when(near_five, F.col("five_prime")).when(
            near_three, F.col("three_prime")),
    }).drop("length", "five_prime", "three_prime")
