"""File-name expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted image types, upload cap in bytes, result suffix.
ALLOWED_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
MAX_UPLOAD_BYTES = 16 * 1024 * 1024
RESULT_SUFFIX = "_overlay.jpg"

# Last dot of the last path part, with something before and after it.
SUFFIX_PATTERN = r"(?s)[^/](\.[^./]+)/*$"
BASENAME_PATTERN = r"(?s)([^/]+)/*$"
PARENT_PATTERN = r"(?s)^(.*/)[^/]+/*$"


def raw_suffix(name: Column) -> Column:
    return F.regexp_extract(name, SUFFIX_PATTERN, 1)


def suffix(name: Column) -> Column:
    """Lower-cased extension with its dot; empty when there is none."""
    return F.lower(raw_suffix(name))


def stem(name: Column) -> Column:
    base = F.regexp_extract(name, BASENAME_PATTERN, 1)
    return F.substring(base, F.lit(1), F.length(base) - F.length(raw_suffix(name)))


def parent(name: Column) -> Column:
    """Directory part including the slash; empty for a bare name."""
    return F.regexp_extract(name, PARENT_PATTERN, 1)


def is_allowed(name: Column) -> Column:
    return F.coalesce(suffix(name).isin(*ALLOWED_SUFFIXES), F.lit(False))


def listing_glob() -> str:
    """Case-insensitive glob of the accepted types, to prune a file listing."""
    kinds = ("".join(f"[{c}{c.upper()}]" for c in s[1:]) for s in ALLOWED_SUFFIXES)
    return "*.{" + ",".join(kinds) + "}"


def identity_key(*parts: Column) -> Column:
    """Collision-free name that a retried task computes again unchanged.

    A missing part is not the same as an empty one, and stays in its place.
    """
    marked = (F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts)
    return F.sha2(F.concat_ws("\0", *marked), 256)


def upload_name(key: Column, name: Column) -> Column:
    return F.concat(key, suffix(name))


def result_name(key: Column) -> Column:
    return F.concat(key, F.lit(RESULT_SUFFIX))


def beside_input(path: Column, out: Column | None = None) -> Column:
    """Result path next to the input, or ``out`` where that is given. Distinct
    inputs may share one."""
    beside = F.concat(parent(path), stem(path), F.lit(RESULT_SUFFIX))
    return beside if out is None else F.coalesce(out, beside)
