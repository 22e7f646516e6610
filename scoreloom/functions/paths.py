"""Paths as columns: scheme stripping, base names, output names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes that only say "a mounted or local path".
MOUNT_SCHEMES = ("file",)


def _scheme(schemes: tuple[str, ...]) -> str:
    return r"^(" + "|".join(map(re.escape, schemes)) + r"):(//)?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_path(path: Column | str, schemes: tuple[str, ...] = MOUNT_SCHEMES) -> Column:
    """Drop a mount scheme, so that ``file:/a`` and ``file:///a`` both become ``/a``."""
    return F.regexp_replace(_col(path), _scheme(schemes), "")


def origin_path(origin: Column | str) -> Column:
    """Path of an ``image`` source row: percent-decoded, then normalised like ``binaryFile`` paths.

    ``url_decode`` reads ``+`` as a blank, so a literal plus is shielded first.
    """
    shielded = F.replace(_col(origin), F.lit("+"), F.lit("%2B"))
    return normalise_path(F.url_decode(shielded))


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def relative_path(path: Column | str, root: str) -> Column:
    """``path`` below ``root``, whichever of the two carries a scheme."""
    bare = re.sub(_scheme(MOUNT_SCHEMES), "", root).rstrip("/")
    return F.regexp_replace(_col(path), r"^([a-z][a-z0-9+.-]*:(//[^/]*)?)?\Q" + bare + r"\E/+", "")


def join_path(folder: Column | str, name: Column) -> Column:
    """Folder and name as one path; a text ``folder`` is a literal."""
    return F.concat_ws("/", F.lit(folder) if isinstance(folder, str) else folder, name)


def ordinal_name(ordinal: Column | str, extension: str, width: int = 6) -> Column:
    """Zero-padded ordinal. Longer numbers keep all their digits (plain ``lpad`` would cut them)."""
    digits = _col(ordinal).cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(padded, F.lit(extension))
