"""Company names as keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Company suffixes, in the order in which they are taken off
SUFFIXES = ["SDN BHD", "SDN. BHD.", "BERHAD", "BHD", "ENTERPRISE", "TRADING", "RESOURCES", "HOLDINGS"]


def normal_name(name: Column) -> Column:
    """Upper case, one form of the private-limited suffix, only A-Z, 0-9 and single blanks."""
    x = F.regexp_replace(F.upper(name), r"\bS/B\b", "SDN BHD")
    x = F.regexp_replace(x, r"\bSDN\.\s*BHD\.?", "SDN BHD")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^A-Z0-9\s]", " "), r"\s+", " "))


def core_name(name: Column) -> Column:
    """The normal name without the suffixes, each taken off once by its text."""
    # a pattern, because the expression may stand only once in each step
    return reduce(lambda x, s: F.trim(F.regexp_replace(x, re.escape(s) + "$", "")), SUFFIXES, normal_name(name))


def name_key(name: Column) -> Column:
    """Equal for strong matches: same core if there is one, else same normal name.

    The flag keeps a core apart from another company's whole name.
    """
    both = F.array(F.struct(core_name(name).alias("core"), normal_name(name).alias("whole")))
    key = F.transform(both, lambda n: F.struct((n["core"] != "").alias("is_core"), F.when(n["core"] != "", n["core"]).otherwise(n["whole"]).alias("key")))[0]
    # never null, and said so: else a join on it looks for nulls below the aggregates, on each of their source rows
    return F.coalesce(key, F.struct(F.lit(False).alias("is_core"), F.lit("").alias("key")))
