"""Column expressions on CIGAR strings and SAM flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
PROPER, UNMAPPED, REVERSE = 0x2, 0x4, 0x10
FIRST, SECOND, SECONDARY, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x800

OPERATION = r"(\d+)([MIDNSHP=X])"


def flag_set(flag: Column | str, mask: int) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return flag.bitwiseAND(F.lit(mask)) != 0


def operations(cigar: Column | str) -> Column:
    """``ARRAY<STRUCT<n, op>>`` in order."""
    sizes = F.regexp_extract_all(cigar, F.lit(OPERATION), F.lit(1))
    letters = F.regexp_extract_all(cigar, F.lit(OPERATION), F.lit(2))
    return F.zip_with(
        sizes, letters,
        lambda n, op: F.struct(n.cast("bigint").alias("n"), op.alias("op")))


def has_operation(cigar: Column | str, letters: tuple[str, ...], at_least: int) -> Column:
    cigar = F.col(cigar) if isinstance(cigar, str) else cigar
    occurs = cigar.rlike("[" + "".join(letters) + "]")
    return occurs & F.exists(
        operations(cigar), lambda o: o["op"].isin(*letters) & (o["n"] >= at_least))


def blocks(cigar: Column | str, pos1: Column) -> Column:
    """Aligned and skipped stretches with their reference and read offsets.

    ``ARRAY<STRUCT<op, ref_start, ref_end, read_start>>`` for M, =, X, D and N,
    0-based half-open.  H and P consume nothing.
    """
    start = F.struct(
        (pos1 - 1).cast("bigint").alias("ref"),
        F.lit(0).cast("bigint").alias("read"),
        F.expr("CAST(array() AS ARRAY<STRUCT<op: STRING, ref_start: BIGINT, "
               "ref_end: BIGINT, read_start: BIGINT>>)").alias("out"),
    )

    def step(state: Column, o: Column) -> Column:
        on_ref = o["op"].isin("M", "=", "X", "D", "N")
        on_read = o["op"].isin("M", "=", "X", "I", "S")
        ref_end = state["ref"] + F.when(on_ref, o["n"]).otherwise(0)
        block = F.struct(
            o["op"].alias("op"), state["ref"].alias("ref_start"),
            ref_end.alias("ref_end"), state["read"].alias("read_start"))
        return F.struct(
            ref_end.alias("ref"),
            (state["read"] + F.when(on_read, o["n"]).otherwise(0)).alias("read"),
            F.when(on_ref, F.concat(state["out"], F.array(block)))
            .otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(operations(cigar), start, step)["out"]
