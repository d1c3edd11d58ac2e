"""Path expressions."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def plain_root(root: str) -> str:
    """A folder without scheme and authority, without a slash at its end; a relative one in full."""
    return re.sub(SCHEME, "", root if re.match(SCHEME, root) else os.path.abspath(root)).rstrip("/")


def normalise(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative_to(path: Column, base: str | Column) -> Column:
    """Path below ``base``; a path that is not below it is returned unchanged.

    Every hash key uses the relative form, so results do not depend on where a folder lives.
    """
    root = F.rtrim(F.lit(base) if isinstance(base, str) else base, F.lit("/"))
    return F.when(
        F.startswith(path, F.concat(root, F.lit("/"))),
        F.substring(path, F.length(root) + 2, F.length(path)),
    ).otherwise(path)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


# Prefixes a block model or texture name may carry, in the order they are dropped.
NAME_PREFIXES = ("minecraft:block/", "block/")


def strip_namespace(name: Column) -> Column:
    """Drop each of the name prefixes once, in order."""
    return F.regexp_replace(name, "^" + "".join(f"({p})?" for p in NAME_PREFIXES), "")


def lower_contains(haystack: Column, needle: str | Column) -> Column:
    wanted = needle.strip().lower() if isinstance(needle, str) else F.lower(F.trim(needle))
    return F.contains(F.lower(haystack), F.lit(wanted) if isinstance(wanted, str) else wanted)
