"""Residue names, codes and letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Residue names with their one-letter symbols; a residue's code is its place here.
RESIDUES = (
    ("VAL", "V"), ("ILE", "I"), ("PHE", "F"), ("TYR", "Y"), ("TRP", "W"), ("ALA", "A"), ("MET", "M"),
    ("LEU", "L"), ("HIS", "H"), ("GLY", "G"), ("CYS", "C"), ("SER", "S"), ("THR", "T"), ("ASN", "N"),
    ("PRO", "P"), ("GLN", "Q"), ("ASP", "D"), ("GLU", "E"), ("LYS", "K"), ("ARG", "R"), ("UNK", "X"),
    ("ASX", "B"), ("GLX", "Z"),
    ("  A", "A"), ("  T", "T"), ("  G", "G"), ("  C", "C"), ("  U", "U"), ("  I", "I"),
    (" +A", "A"), (" +T", "T"), (" +G", "G"), (" +C", "C"), (" +U", "U"), (" +I", "I"),
    (" DA", "A"), (" DT", "T"), (" DG", "G"), (" DC", "C"), (" DU", "U"), (" DI", "I"),
)
UNKNOWN = 20

# Labels given to output chains, in order.
CHAIN_LABELS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ1234567890~!@#$%^&()-+=_<>/'\\?\"[]{}abcdefghijklmnopqrstuvwxyz"
)
N_LABELS = len(CHAIN_LABELS)


def in_capitals(letters: Column) -> Column:
    """a-z as A-Z; other letters stay, whatever a locale makes of them."""
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def residue_table(spark: SparkSession) -> DataFrame:
    """The fixed lookup (res_name, code, letter); about forty rows."""
    return spark.createDataFrame(
        [(name, code, letter) for code, (name, letter) in enumerate(RESIDUES)],
        "res_name string, code int, letter string")


def with_codes(residues: DataFrame) -> DataFrame:
    """Add ``code`` and ``letter``; unknown names get code 20 and X.  The lookup side is fixed size."""
    lookup = F.broadcast(residue_table(residues.sparkSession))
    return residues.join(lookup, "res_name", "left").withColumn(
        "code", F.coalesce("code", F.lit(UNKNOWN))).withColumn("letter", F.coalesce("letter", F.lit("X")))


def chain_label(ordinal: Column) -> Column:
    """Label of the n-th output chain; repeats after the alphabet is used up."""
    return F.substring(F.lit(CHAIN_LABELS), (F.pmod(ordinal, F.lit(N_LABELS)) + 1).cast("int"), F.lit(1))
