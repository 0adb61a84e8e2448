"""Newick text by regular expression, without parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of names, lengths and supports in tree text.
LABEL_BEFORE_LENGTH = r"([^(),:]+):"
NUMBER_ONLY = r"^[0-9.+Ee-]+$"
LEAF_NAME = r"([A-Za-z_][A-Za-z0-9_.-]*)\s*(?=[:),])"
LENGTH_ANY = r":([0-9.eE+-]+)"
LENGTH_PLAIN = r":([0-9]*\.?[0-9]+(?:e-?\d+)?)"
SUPPORT = r"\)([0-9]+(?:\.[0-9]+)?)"
BLANKS = r"\s+"


def labels(newick: Column) -> Column:
    """Labels followed by a length, first-seen order, numbers left out."""
    found = F.regexp_extract_all(newick, F.lit(LABEL_BEFORE_LENGTH), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: ~s.rlike(NUMBER_ONLY)))


def leaf_names(newick: Column) -> Column:
    """Names that start with a letter, first-seen order."""
    return F.array_distinct(F.regexp_extract_all(newick, F.lit(LEAF_NAME), F.lit(1)))


def longest_edge(newick: Column, pattern: str = LENGTH_ANY) -> Column:
    """Largest branch length in the text, 0 without any."""
    found = F.regexp_extract_all(newick, F.lit(pattern), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda s: s.try_cast("double"))),
                      F.lit(0.0))


def shape_key(newick: Column) -> Column:
    """Text without lengths, supports and blanks: equal text, equal topology."""
    bare = F.regexp_replace(newick, LENGTH_PLAIN, "")
    return F.regexp_replace(F.regexp_replace(bare, SUPPORT, ")"), BLANKS, "")


def is_blank(c: Column) -> Column:
    """NULL or only white space."""
    return c.isNull() | (F.trim(c.cast("string")) == "")
