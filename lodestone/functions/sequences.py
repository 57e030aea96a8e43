"""Biological sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import chars

#: Label and codons of the genetic code, covering all 64 codons.
CODONS = {
    "Phenylalanine (Phe, F)": "UUU UUC",
    "Leucine (Leu)": "UUA UUG CUU CUC CUA CUG",
    "Isoleucine (Ile)": "AUU AUC AUA",
    "Methionine (Met) — Start Codon": "AUG",
    "Valine (Val)": "GUU GUC GUA GUG",
    "Serine (Ser)": "UCU UCC UCA UCG AGU AGC",
    "Arginine (Arg)": "CGU CGC CGA CGG AGA AGG",
    "Proline (Pro)": "CCU CCC CCA CCG",
    "Threonine (Thr)": "ACU ACC ACA ACG",
    "Alanine (Ala)": "GCU GCC GCA GCG",
    "Tyrosine (Tyr)": "UAU UAC",
    "Histidine (His)": "CAU CAC",
    "Glutamine (Gln)": "CAA CAG",
    "Asparagine (Asn)": "AAU AAC",
    "Lysine (Lys)": "AAA AAG",
    "Aspartic Acid (Asp)": "GAU GAC",
    "Glutamic Acid (Glu)": "GAA GAG",
    "Cysteine (Cys)": "UGU UGC",
    "Tryptophan (Trp)": "UGG",
    "Glycine (Gly)": "GGU GGC GGA GGG",
    "Stop Codons": "UAA UAG UGA",
}


def codon_dim(spark: SparkSession) -> DataFrame:
    """64 rows: codon, label."""
    return spark.createDataFrame([(c, label) for label, cs in CODONS.items() for c in cs.split()], "codon string, label string")


def starts(length: Column, width: Column, step: int = 1) -> Column:
    """0-based starts of windows of a width in a text of a length; none if it is too short."""
    return F.when((length >= width) & (width > 0), F.sequence(F.lit(0), length - width, F.lit(step))).otherwise(F.array().cast("array<int>"))


def kmers(s: Column, k: int) -> Column:
    return F.transform(starts(F.length(s), F.lit(k)), lambda i: F.substr(s, i + 1, F.lit(k)))


def codons(s: Column) -> Column:
    """Windows of three, side by side; a rest of one or two is dropped."""
    return F.transform(starts(F.length(s), F.lit(3), 3), lambda i: F.substr(s, i + 1, F.lit(3)))


def motif_starts(s: Column, motif: Column) -> Column:
    """0-based starts, overlapping ones included."""
    return F.filter(starts(F.length(s), F.length(motif)), lambda i: F.substr(s, i + 1, F.length(motif)) == motif)


def transcribe(dna: Column) -> Column:
    return F.replace(F.upper(dna), F.lit("T"), F.lit("U"))


def complement(dna: Column) -> Column:
    """Null where a letter other than A, C, G, T occurs."""
    up = F.upper(dna)
    return F.when(up.rlike("^[ACGT]*$"), F.translate(up, "ACGT", "TGCA"))


def reverse_complement(dna: Column) -> Column:
    return F.reverse(complement(dna))


def share_of(s: Column, letters: str) -> Column:
    """Percent of the characters that are among ``letters``; null for an empty text."""
    found = F.length(s) - F.length(F.translate(s, letters, ""))
    return F.try_divide(100.0 * found, F.length(s))


def matches(a: Column, b: Column) -> Column:
    """Positions with equal characters, over the shorter length. Each text is split once."""
    return F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x == y), lambda same: same))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; null for unequal lengths."""
    return F.when(F.length(a) == F.length(b), F.length(a) - matches(a, b))


def hamming_status(a: Column, b: Column) -> Column:
    """Why :func:`hamming` is a number or null."""
    return F.when(a.isNull() | b.isNull(), "a text is missing").when(F.length(a) == F.length(b), "ok").otherwise("lengths differ")
