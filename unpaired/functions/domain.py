"""Scores of sequences and predicted structures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published Kyte-Doolittle hydropathy scale.
KYTE_DOOLITTLE = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

# The published TOP-IDP disorder propensity scale.
TOP_IDP = {
    "W": -0.884, "F": -0.697, "Y": -0.510, "I": -0.486, "M": -0.397, "L": -0.326, "V": -0.121, "N": 0.007, "C": 0.02, "T": 0.059,
    "A": 0.06, "G": 0.166, "R": 0.180, "D": 0.192, "H": 0.303, "Q": 0.318, "S": 0.341, "K": 0.586, "E": 0.736, "P": 0.987,
}


def residue_mean(sequence: Column, scale: dict[str, float]) -> Column:
    """Mean of the scale over the known residues; null if there are none."""
    table = F.create_map(*[x for k, v in scale.items() for x in (F.lit(k), F.lit(v))])
    known = F.filter(F.transform(F.split(F.upper(sequence), ""), lambda c: F.try_element_at(table, c)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))


def hydrophobicity(sequence: Column) -> Column:
    """Kyte-Doolittle mean scaled from [-4.5, 4.5] to [0, 1]."""
    return (residue_mean(sequence, KYTE_DOOLITTLE) + 4.5) / 9.0


def disorder(sequence: Column) -> Column:
    return residue_mean(sequence, TOP_IDP)


def pdockq(mean_plddt: Column, contacts: Column) -> Column:
    """Sigmoid of the interface confidence times the natural logarithm of its contacts; 0 without any."""
    # The published fit.
    x = mean_plddt * F.log(contacts)
    return F.when(contacts > 0, 0.724 / (1 + F.exp(-0.052 * (x - 152.611))) + 0.018).otherwise(0.0)
