"""Genomic tables derived from the driver's parquet tables.

Every adapter covers its whole source table; the matching SQL lives in
``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.session import cut_lineage, spread
from locusframe.sources.fasta import chunked


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows get much work each, spread over all slots."""
    return spread(table(spark, folder, name))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as stranded intervals, one sequence per supplier."""
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 60000
    confidence = F.when(F.col("l_discount") > 0.08, "uncertain").otherwise("high")
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("chr"), "l_suppkey").alias("seqid"),
        start.alias("start_pos"),
        (start + F.col("l_quantity").cast("int")).alias("end_pos"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey",
                    F.col("l_extendedprice").cast("bigint")).alias("entity_id"),
        F.when(F.col("l_returnflag") == "A", "+")
        .when(F.col("l_returnflag") == "N", "-").otherwise(".").alias("strand"),
        confidence.alias("start_conf"),
        confidence.alias("end_conf"),
    )


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as sequences of one length with a class and two end states."""
    key = F.col("s_suppkey")

    def status(step: int):
        return F.when(key % step == 0, "partial").when(key % step == 1, "unknown").otherwise("complete")

    return table(spark, folder, "supplier").select(
        F.concat(F.lit("chr"), key).alias("seqid"),
        F.lit(60100).cast("bigint").alias("length"),
        F.when(key % 10 == 0, "unlocalized_scaffold").otherwise("nuclear_chromosome").alias("seq_class"),
        status(7).alias("five_prime"),
        status(5).alias("three_prime"),
        *[F.lit(f"{end} {what}").alias(f"{end}_{what}")
          for end in ("five_prime", "three_prime") for what in ("evidence", "declaration")],
    )


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as exclusion zones spread over the supplier sequences."""
    suppliers = table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()
    start = (F.col("o_orderkey") * 53) % 60000
    return table(spark, folder, "orders").select(
        F.concat(F.lit("chr"), (F.col("o_custkey") % suppliers + 1)).alias("seqid"),
        start.alias("start_pos"),
        (start + 10 + F.col("o_custkey") % 40).alias("end_pos"),
        F.concat(F.lit("zone_"), F.lower("o_orderstatus")).alias("rule_id"),
        F.col("o_orderpriority").alias("reason"),
        F.col("o_orderkey").alias("ordinal"),
    )


#: A base for every letter: A, C, G, T and N stand for themselves, the others go round.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE_OF = "".join(x if x in "ACGTN" else "ACGT"[i % 4] for i, x in enumerate(LETTERS))


def documents_as_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sequences: every character is a base, N if it is no ASCII letter."""
    letters = F.translate("text", LETTERS + LETTERS.lower(), BASE_OF * 2)
    return rows(spark, folder, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("seqid"),
        F.lit(0).cast("bigint").alias("start_pos"),
        F.regexp_replace(letters, "[^ACGTN]", "N").alias("bases"),
    )


def document_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written sequences, their lengths, and the written chunk store."""
    pieces = cut_lineage(documents_as_bases(spark, folder))
    lengths = pieces.select("seqid", F.length("bases").cast("bigint").alias("length"))
    return pieces, lengths, cut_lineage(chunked(pieces, ["seqid"]))


def gff_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as genes and events as their children, as GFF3 text lines."""
    orders, events = rows(spark, folder, "orders"), rows(spark, folder, "events")
    key = F.col("o_orderkey")
    start = (key * 37) % 50000 + 1
    gene_attributes = F.concat(
        F.lit("ID=g"), key, F.lit(";Name=gene "), key, F.lit(";Note=a%2Cb,c+d;Dbxref=GeneID:"), key,
        F.when(F.col("o_orderpriority") == "1-URGENT", ";partial=true").otherwise(""),
        F.when(key % 5 == 0, F.concat(F.lit(";start_range=.,"), start)).otherwise(""),
        F.when(key % 7 == 0, F.concat(F.lit(";end_range="), start, F.lit(",."))).otherwise(""),
    )
    genes = orders.select(
        (key * 2).alias("line_number"),
        F.concat_ws(
            "\t", F.concat(F.lit("chr"), F.col("o_custkey") % 50), F.lit("src"), F.lit("gene"),
            start, start + 200 + F.col("o_custkey") % 50, F.lit("."),
            F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-")
            .otherwise("."),
            F.lit("."), gene_attributes).alias("value"))
    event = F.col("event_id")
    group = F.floor(event / 8)
    head = event % 8 == 0
    kind = (
        F.when(head & (F.col("event_type") == "error"), "region").when(head, "mRNA")
        .when(F.col("event_type") == "click", "mRNA").when(F.col("event_type") == "view", "exon")
        .when(F.col("event_type") == "error", "CDS").otherwise("region"))
    identity = F.when(kind == "CDS", F.concat(F.lit("cds"), group)).otherwise(
        F.concat(F.lit("e"), event))
    parent = (
        F.when(head, F.concat(F.lit("g"), event))
        .when(kind == "mRNA", F.concat(F.lit("g"), event * 2))
        .otherwise(F.concat(F.lit("e"), group * 8)))
    place = (event * 53) % 50000 + 1
    children = events.select(
        (event * 2 + 1).alias("line_number"),
        F.concat_ws(
            "\t", F.concat(F.lit("chr"), F.floor(event / 64) % 50), F.lit("src"), kind,
            place, place + 60, F.lit("."), F.lit("+"), F.lit("."),
            F.concat(F.lit("ID="), identity, F.lit(";Parent="), parent)).alias("value"))
    return genes.unionByName(children).select(F.lit("gff").alias("file"), "line_number", "value")


def sam_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as read pairs, some with a further record, as SAM text lines."""
    suppliers = table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    unmapped = key % 11 == 0
    half = key % 13 == 0
    third = F.when(customer % 5 == 0, 355).when(customer % 5 == 1, 2147)
    records = rows(spark, folder, "orders").select(
        key, customer, unmapped.alias("u"), half.alias("h"),
        F.explode(F.array_compact(F.array(F.lit(0), F.lit(1), F.when(third.isNotNull(), 2)))).alias("k"),
        third.alias("third"))
    k = F.col("k")
    lost = F.col("u") | (F.col("h") & (k == 1))
    cigars = F.array(*[F.lit(c) for c in ("10M", "5M10N5M", "25S5M", "4M22I4M", "6M30D6M", "3M7N4M9N3M")])
    flag = (
        F.when(F.col("k") == 2, F.col("third"))
        .when(F.col("u"), F.when(k == 0, 77).otherwise(141))
        .when(F.col("h"), F.when(k == 0, 73).otherwise(133))
        .when(key % 3 == 0, F.when(k == 0, 65).otherwise(129))
        .otherwise(F.when(k == 0, 99).otherwise(147)))
    # A quarter of the pairs piles up on one locus of three sequences.
    name = F.concat(F.lit("chr"), F.when(key % 4 == 0, customer % 3).otherwise((customer + k) % suppliers))
    place = F.when(key % 4 == 0, 20001 + key % 97 + k * 20).otherwise((key * 37 + k * 20) % 59000 + 1)
    copies = F.when(key % 17 == 0, F.lit("")).otherwise(
        F.concat(F.lit("\tNH:i:"), F.when((key % 7 == 0) | (k == 2), 2).otherwise(1)))
    return records.select(
        F.lit("sam").alias("file"),
        (key * 4 + k).alias("line_number"),
        F.concat(
            F.concat_ws(
                "\t", F.concat(F.lit("q"), key), flag,
                F.when(lost & (k < 2), "*").otherwise(name),
                F.when(lost & (k < 2), 0).otherwise(place),
                F.lit(60),
                F.when(lost & (k < 2), "*").otherwise(F.get(cigars, ((key + k) % 6).cast("int"))),
                F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*")),
            F.when(lost & (k < 2), F.lit("")).otherwise(copies)).alias("value"),
    )


def forest_links(spark: SparkSession, folder: str) -> DataFrame:
    """Orders below customers below nations, as child-parent links."""
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("child_id"),
        F.concat(F.lit("c"), "o_custkey").alias("parent_id"))
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("child_id"),
        F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return orders.unionByName(customers)


def loose_features(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with repeated ids, and orders that name them as parents."""
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    empty = F.expr("CAST(map() AS MAP<STRING, ARRAY<STRING>>)")
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 60000
    items = table(spark, folder, "lineitem").select(
        F.concat(F.lit("i"), "l_orderkey").alias("feature_id"),
        none.alias("parents"),
        F.concat(F.lit("chr"), F.col("l_orderkey") % 50).alias("seqid"),
        F.when(F.col("l_orderkey") % 2 == 0, "CDS").otherwise("gene").alias("feature_type"),
        start.alias("start_pos"), (start + F.col("l_quantity").cast("int")).alias("end_pos"),
        F.lit("+").alias("strand"), empty.alias("attributes"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_number"))
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("x"), "o_orderkey").alias("feature_id"),
        F.array(F.concat(F.lit("i"), "o_orderkey")).alias("parents"),
        F.concat(F.lit("chr"), F.col("o_orderkey") % 50).alias("seqid"),
        F.lit("mRNA").alias("feature_type"),
        F.col("o_orderkey").alias("start_pos"), (F.col("o_orderkey") + 10).alias("end_pos"),
        F.lit("+").alias("strand"), empty.alias("attributes"),
        (F.col("o_orderkey") * 100 + 50).alias("line_number"))
    return items.unionByName(orders)


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Events as workflow steps: one run per 100 events, numbered within it."""
    events = table(spark, folder, "events")
    return events.select(
        F.floor(F.col("event_id") / 100).alias("run_id"),
        (F.col("event_id") % 100 + 1).alias("step"),
        F.col("ts").alias("started"),
        F.timestamp_add("SECOND", F.col("value").cast("int"), F.col("ts")).alias("completed"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 1000 < 100), 1)
        .otherwise(0).alias("exit_code"))


def document_files(spark: SparkSession, folder: str, changed: bool = False) -> DataFrame:
    """Documents as files of a run; ``changed`` gives the files of a peer run."""
    documents = table(spark, folder, "documents")
    text = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    body = text if changed else F.col("text")
    skip = F.col("doc_id") % 13 == (1 if changed else 2)
    return documents.where(~skip).select(
        F.concat(F.lit("doc"), "doc_id").alias("name"), F.sha2(body.cast("binary"), 256).alias("sha256"),
        F.octet_length(body).cast("bigint").alias("size_bytes"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as runs: baselines and candidate runs with a parent."""
    key = F.col("c_custkey")
    text = F.lit(None).cast("string")
    child = key % 3 == 1
    return table(spark, folder, "customer").select(
        F.concat(F.lit("r"), key).alias("run_id"),
        F.when(child, F.concat(F.lit("r"), key - 1)).otherwise(text).alias("parent_run_id"),
        F.when(child, "v1").otherwise(text).alias("rule_version"),
        F.when(key % 10 == 9, 1).otherwise(2).alias("schema_version"),
        F.when(child, text).otherwise(F.col("c_mktsegment")).alias("target_strain"),
        F.when(key % 8 == 0, "failed").otherwise("complete").alias("execution_status"),
        F.lit("pending").alias("verification_status"),
        F.lit("blocked").alias("scientific_acceptance_status"),
    )


def run_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts of the runs, drawn from the names that each type must list."""
    from locusframe.operators.provenance import REQUIRED_ARTIFACTS

    names = sorted({n for group in REQUIRED_ARTIFACTS.values() for n in group})
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key, F.posexplode(F.array(*[F.lit(n) for n in names])).alias("at", "name")
    ).where((key % 5 != 3) | (F.col("at") != 4)).select(
        F.concat(F.lit("r"), key).alias("run_id"), "name",
        (key * 10 + F.col("at")).alias("size_bytes"),
        F.sha2(F.concat_ws("/", key, "name"), 256).alias("sha256"))


def artifact_identities(spark: SparkSession, folder: str) -> DataFrame:
    """What a scan of the run folders would find: a few sizes differ."""
    key = F.substring("run_id", 2, 20).cast("bigint")
    return run_artifacts(spark, folder).withColumn(
        "size_bytes", F.when((key % 7 == 0) & (F.col("name") == "statistics.json"),
                             F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))


def acceptance(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").where(F.col("c_custkey") % 4 == 0).select(
        F.concat(F.lit("r"), "c_custkey").alias("run_id"),
        F.lit("passed").alias("verification_status"),
        F.when(F.col("c_acctbal") > 0, "accepted").otherwise("blocked").alias("scientific_acceptance_status"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sequenced samples of a study per customer."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("study"), "o_custkey").alias("study"),
        F.concat(F.lit("s"), F.floor(F.col("o_orderkey") / 2)).alias("sample"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("replicate"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("collection_date"),
        F.col("o_orderstatus").alias("status_code"),
    )
