"""Identifier clean-up shared by every operator that lines tables up by ID."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The image suffixes dropped from IDs, tried in this order.
DEFAULT_SUFFIXES = (".nii.gz", ".nii")

_DIGITS = "0123456789"
_VOLUME_FILE = r"^(.*)_[0-9]+\.nii\.gz$"


def strip_suffixes(value: Column, suffixes=DEFAULT_SUFFIXES) -> Column:
    """Drop the first listed suffix the value ends with, at most one."""
    chain = None
    for suffix in suffixes:
        if not suffix:
            continue
        cut = value.substr(F.lit(1), F.length(value) - F.lit(len(suffix)))
        hit = value.endswith(suffix)
        chain = F.when(hit, cut) if chain is None else chain.when(hit, cut)
    return value if chain is None else chain.otherwise(value)


def strip_reconstruction(value: Column) -> Column:
    """Drop one trailing ``_<digits>`` (by trims, which are cheaper than a pattern)."""
    bare = F.rtrim(value, F.lit(_DIGITS))
    numbered = bare.endswith("_") & (F.length(bare) < F.length(value))
    head = bare.substr(F.lit(1), F.length(bare) - F.lit(1))
    return F.when(numbered, head).otherwise(value)


def scan_id(volume: Column) -> Column:
    """Scan a volume belongs to: the part before ``_<n>.nii.gz``, else the name as is."""
    name = F.coalesce(volume.cast("string"), F.lit(""))
    return F.when(name.rlike(_VOLUME_FILE), F.regexp_extract(name, _VOLUME_FILE, 1)).otherwise(name)


@dataclass(frozen=True)
class IdRule:
    """How the IDs of two tables are made comparable.

    Null IDs become the text ``nan`` and so match each other, as they do in a
    table whose ID column was cast to text.
    """

    suffixes: tuple[str, ...] = DEFAULT_SUFFIXES
    keep_reconstruction_suffix: bool = False

    def apply(self, value: Column) -> Column:
        name = F.coalesce(value.cast("string"), F.lit("nan"))
        name = strip_suffixes(name, self.suffixes)
        return name if self.keep_reconstruction_suffix else strip_reconstruction(name)
