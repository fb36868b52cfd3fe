"""Dimension policy: subjects, families, phases and which editions may be used, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of school subjects, phases and series.
SUBJECT_ALIASES = {"生物": "生物学", "政治": "思想政治", "外语": "英语", "道法": "道德与法治"}
SUBJECT_FAMILIES = {"生物学": "生命科学", "思想政治": "德育", "道德与法治": "德育"}
SERIES_PHASES = [
    ("义务教育教科书", "初中"), ("义务教育课程标准实验教科书", "初中"),
    ("普通高中教科书", "高中"), ("普通高中课程标准实验教科书", "高中"),
]
MAIN_EDITION = "人教版"
EXTRA_EDITIONS = {"英语": "北师大版", "化学": "鲁科版"}


def _mapped(value: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value], value)


def canonical_subject(raw: Column) -> Column:
    """The subject that an alias stands for."""
    return _mapped(F.trim(raw), SUBJECT_ALIASES)


def display_subject(phase: Column, subject: Column) -> Column:
    """The name of a subject in a phase."""
    return F.when((phase == "初中") & (subject == "生物学"), "生物").otherwise(subject)


def subject_family(subject: Column) -> Column:
    return _mapped(subject, SUBJECT_FAMILIES)


def phase_of_series(label: Column) -> Column:
    """The phase that a series label names, null if none."""
    return F.coalesce(*[F.when(label.contains(mark), phase) for mark, phase in SERIES_PHASES])


def edition_allowed(phase: Column, subject: Column, edition: Column) -> Column:
    """The main edition in both phases, and one more for two subjects of the upper phase."""
    extra = F.create_map(*[F.lit(x) for kv in EXTRA_EDITIONS.items() for x in kv])[subject]
    upper = (edition == MAIN_EDITION) | edition.eqNullSafe(extra) & edition.isNotNull()
    return F.coalesce(F.when(phase == "高中", upper).when(phase == "初中", edition == MAIN_EDITION), F.lit(False))


def catalogue_visible(phase: Column, subject: Column, edition: Column, role: Column, has_images: Column) -> Column:
    """Primary books of an allowed edition, and supplemental ones that have page images."""
    ok = role.isin("primary", "primary_bound") | (role == "supplemental_only") & has_images
    return edition_allowed(phase, subject, edition) & F.coalesce(ok, F.lit(False))


def images_allowed(phase: Column, subject: Column, edition: Column, has_images: Column) -> Column:
    return has_images & edition_allowed(phase, subject, edition)
