"""Scalar functions on taxa: labels, lineages, similarity, sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.operators.study import LEVELS, UNDEFINED

_TOKEN = re.compile(r"%\((\w+)\)s")


def format_label(template: str) -> Column:
    """A label template: %(name)s, %(index)s, %(id)s, %(paperformat)s and the levels; other tokens stay as they are."""
    known = {"name": F.col("name"), "index": F.col("idx").cast("string"), "id": F.col("idx").cast("string")} | {c: F.col(c) for c in LEVELS}
    parts: list[Column] = []
    at = 0
    for m in _TOKEN.finditer(template):
        got = paper_label() if m[1] == "paperformat" else known.get(m[1])
        if got is None:
            continue
        parts += [F.lit(template[at : m.start()]), got]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def paper_label() -> Column:
    """genus, up to two species and the name; else stars and the lowest defined level and the name."""
    species = F.split("species", "/")
    short = F.array_join(F.when(F.size(species) >= 3, F.slice(species, 1, 2)).otherwise(species), "/")
    out = F.when(F.col("species") != UNDEFINED, F.concat_ws(" ", "genus", short, "name"))
    for stars, lv in enumerate(reversed(LEVELS[:-1]), 1):
        out = out.when(F.col(lv) != UNDEFINED, F.concat_ws(" ", F.lit("*" * stars), lv, "name"))
    return out.otherwise(F.concat_ws(" ", F.lit(UNDEFINED), "name"))


def lineage_array(to: str | None = None) -> Column:
    """The levels down to ``to``; None and 'asv' end with the taxon's name."""
    if to in (None, "asv"):
        return F.array(*LEVELS, "name")
    return F.array(*LEVELS[: LEVELS.index(to) + 1])


def taxonomic_similarity(a: Column, b: Column) -> Column:
    """Equal leading levels of two full lineages, over 8."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(a)).otherwise(first - 1) / F.size(a)


def gram_negative(phylum: str = "phylum") -> Column:
    """true, false, or NULL where the phylum is undefined or not in the table."""
    p = F.lower(F.col(phylum))
    # fixed values
    return F.when(p.isin("bacteroidetes", "verrucomicrobia", "proteobacteria"), True).when(p == "firmicutes", False)


def hamming(u: Column, v: Column, ignore: str = "N") -> Column:
    """Places that differ, those with ``ignore`` on either side left out; NULL for unequal lengths."""
    pairs = F.zip_with(F.split(u, ""), F.split(v, ""), lambda a, b: ((a != b) & (a != ignore) & (b != ignore)).cast("int"))
    return F.when(F.length(u) == F.length(v), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def evidence_category(bf: str) -> Column:
    """3 above 100, 2 above 10, 1 above 0, else 0."""
    b = F.col(bf)
    return F.when(b > 100, 3).when(b > 10, 2).when(b > 0, 1).otherwise(0)
