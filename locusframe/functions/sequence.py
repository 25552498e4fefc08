"""Column expressions on bases and strands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabet of sequence files and unstranded canonical motifs.
ALPHABET = "ACGTURYSWKMBDHVN.-*"
CANONICAL_MOTIFS = ("GT-AG", "GC-AG", "AT-AC", "CT-AC", "CT-GC", "GT-AT")

# Words that declare or deny a strand protocol.
STRAND_NEGATIVE = ("unstranded", "not stranded", "unknown", "strand unknown", "unspecified")
STRAND_EXPLICIT = (
    "stranded", "directional", "forward", "reverse", "first-strand", "second-strand")


def reverse_complement(bases: Column | str) -> Column:
    """Only A, C, G, T and N have a complement; other letters stay."""
    return F.reverse(F.translate(bases, "ACGTN", "TGCAN"))


def has_bad_symbol(bases: Column | str) -> Column:
    return F.length(F.translate(bases, ALPHABET, "")) > 0


def splice_motif(donor: Column, acceptor: Column) -> Column:
    return F.concat(donor, F.lit("-"), acceptor)


def is_canonical(motif: Column) -> Column:
    return motif.isin(*CANONICAL_MOTIFS)


def flip_strand(strand: Column, reverse: Column) -> Column:
    flipped = F.when(strand == "+", "-").when(strand == "-", "+").otherwise(strand)
    return F.when(reverse, flipped).otherwise(strand)


def strand_declaration(words: Column) -> Column:
    """``declared`` or ``unavailable`` from the texts of a library description."""
    texts = F.transform(words, lambda w: F.lower(F.trim(w)))
    negative = F.arrays_overlap(texts, F.array(*[F.lit(w) for w in STRAND_NEGATIVE]))
    explicit = F.arrays_overlap(texts, F.array(*[F.lit(w) for w in STRAND_EXPLICIT]))
    return F.when(~F.coalesce(negative, F.lit(False)) & F.coalesce(explicit, F.lit(False)),
                  "declared").otherwise("unavailable")
