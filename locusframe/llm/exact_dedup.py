"""Exact deduplication by a tree merge of sorted digest runs.

Rows are dealt to runs by the hash of their id.  A run holds one entry per
digest, sorted; in each round the entries of ``fan_in`` runs are exchanged to
one place and merged, and every merge keeps the verified best identifier and
adds the counts.  After log(runs) rounds one run is left.  Its entries go back
down the same tree, so that a digest which holds a third of all rows is still
joined in as many pieces as there are runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut_lineage
from locusframe.session import broadcast_if_small

KEY = ["digest", "check", "bytes"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, code points of the text, and digest, second hash and byte length of the normalised text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    return (docs.select(F.col(id_col).alias("id"), F.length(text).alias("chars"), plain.alias("plain"))
            .select("id", "chars", F.unhex(F.sha2(F.col("plain").cast("binary"), 256)).alias("digest"),
                    F.xxhash64("plain").alias("check"), F.octet_length("plain").alias("bytes")))


def merge_runs(entries: DataFrame, runs: int = 64, fan_in: int = 4) -> tuple[DataFrame, DataFrame]:
    """The lowest runs, and the one run that all rounds leave.

    Digests merge only where the second hash and the byte length of the texts
    agree too, at every level.
    """
    lowest = entries.groupBy("run", *KEY).agg(
        F.min(F.struct((-F.col("chars")).alias("shorter"), F.col("id").isNull().alias("unnamed"), "id")).alias("best"),
        F.count("*").alias("size"))
    merged = lowest
    while runs > 1:
        merged = merged.groupBy(F.floor(F.col("run") / fan_in).alias("run"), *KEY).agg(
            F.min("best").alias("best"), F.sum("size").alias("size"))
        runs = -(-runs // fan_in)
    return lowest, merged.drop("run")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if they are identical without ASCII white space; a null
    text counts as empty, and all empty texts are one group.  The row with the
    most code points in its original text stays, then the smallest id; a null
    id comes last.  Of repeated rows (same id, same length) exactly one is
    kept.  An empty table gives an empty result.  Other columns, whatever
    their names, are not read.
    """
    entries = cut_lineage(digests(docs, id_col, text_col).withColumn(
        "run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("long")))
    lowest, one = merge_runs(entries, runs, fan_in)
    down = lowest.select("run", *KEY).join(one, KEY)
    same = Window.partitionBy("run", *KEY, "id").orderBy(F.col("chars").desc())
    best = F.col("best.id")
    return (entries.join(down, ["run", *KEY])
            .withColumn("copy", F.row_number().over(same))
            .select(F.col("id").alias(id_col), best.alias("keep_id"), F.col("size").alias("group_size"),
                    (F.col("id").eqNullSafe(best) & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Decisions are joined by id and digest; repeated rows (same id, same
    normalised text) leave one row.  The texts are shuffled only where the
    table of rows to drop is too large to broadcast.
    """
    decided = cut_lineage(exact_duplicates(docs, id_col, text_col)
                          .select(F.xxhash64(F.col(id_col), "text_sha256").alias("__exact_key"), F.col(id_col).alias("_id"),
                                  F.col("text_sha256").alias("_sha"), "kept"))
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "")
    keyed = docs.withColumn("__exact_key", F.xxhash64(F.col(id_col), F.sha2(plain.cast("binary"), 256)))
    dropped = cut_lineage(decided.groupBy("__exact_key").agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count("*").alias("n"))
                          .where("n > stay"))
    out = keyed.join(broadcast_if_small(dropped.select("__exact_key")), "__exact_key", "left_anti")
    mixed = dropped.where("stay > 0").select("__exact_key")
    if not mixed.isEmpty():  # repeated rows: an id that both stays and goes
        longest = Window.partitionBy("__exact_key").orderBy(F.length(F.col(text_col)).desc_nulls_last())
        again = (keyed.join(broadcast_if_small(mixed), "__exact_key", "left_semi")
                 .withColumn("__exact_copy", F.row_number().over(longest)).where("__exact_copy = 1").drop("__exact_copy"))
        out = out.unionByName(again)
    return out.select(*docs.columns)
