"""Path functions: category, type, base name, ground truth by name and crop class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The class of each crop folder; 1 is no crop.
CROPS = {"crop5": 2, "crop10": 3, "crop20": 4, "crop30": 5, "crop50": 6, "crop70": 7, "crop90": 8}


def _parts(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.split(path, "/")).otherwise(F.split(path, r"\\"))


def category(path: Column) -> Column:
    """The parent directory's name, by the last slash or else the last backslash; empty where there is none."""
    return F.coalesce(F.try_element_at(_parts(path), F.lit(-2)), F.lit(""))


def object_type(path: Column) -> Column:
    """The category up to its first underscore."""
    return F.substring_index(category(path), "_", 1)


def base_name(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.element_at(_parts(path), -1), r"\.[^.]*$", "")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def moved(path: Column, old: str, new: str, suffix: str) -> Column:
    """The path below another directory, without extension and with a suffix; null if it isn't below ``old``."""
    return F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substr(without_extension(path), F.lit(len(old) + 1)), F.lit(suffix)))


def is_match(found: Column, asked: Column) -> Column:
    """Whether a result's base name begins with the query's and an underscore."""
    return F.startswith(base_name(found), F.concat(base_name(asked), F.lit("_")))


def crop_class(found: Column, asked: Column) -> Column:
    """The crop class from the path, negative unless the names match; 1 or -1 without a crop. Of several
    crop folders the smallest counts."""
    size = F.lit(1)
    for name, k in reversed(CROPS.items()):
        size = F.when(F.contains(found, F.lit(f"\\{name}\\")) | F.contains(found, F.lit(f"/{name}/")), F.lit(k)).otherwise(size)
    return F.when(is_match(found, asked), size).otherwise(-size)
