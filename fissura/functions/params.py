"""Tuning parameters from raw text.

``lenient`` follows the upload form: missing fields take their default, one
bad field resets all three, values are clamped. ``strict`` follows the command
line: values are used as given and bad text is an error, of its row alone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Form defaults, limits and the default colour (B,G,R).
DEFAULT_CONF, DEFAULT_ALPHA, DEFAULT_OUTLINE = 0.25, 0.5, 2
CONF_RANGE, ALPHA_RANGE, OUTLINE_RANGE = (0.0, 1.0), (0.0, 1.0), (0, 10)
DEFAULT_COLOUR = (0, 0, 255)
INT_RANGE = (-2147483648.0, 2147483647.0)
COLOUR_MESSAGE = "color must be 'B,G,R', e.g. 0,0,255"

# Number texts that count as valid. Spark's cast alone also takes `0.5f` and hex.
_DIGITS = r"\d(?:_?\d)*"
FLOAT_PATTERN = (
    rf"^\s*([+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf|infinity|nan)))\s*$"
)
INT_PATTERN = rf"^\s*([+-]?{_DIGITS})\s*$"
COLOUR_PATTERN = "^" + ",".join([rf"\s*([+-]?{_DIGITS})\s*"] * 3) + "$"


def _number(text: Column, pattern: str) -> Column:
    core = F.regexp_replace(F.regexp_extract(text, pattern, 1), "_", "")
    return (
        F.when(F.lower(core).isin("nan", "+nan", "-nan"), F.lit(float("nan")))
        .when(core != "", core.try_cast("double"))
    )


def parse_float(text: Column) -> Column:
    """Double, or NULL when the text is no number."""
    return _number(text, FLOAT_PATTERN)


def parse_int(text: Column) -> Column:
    """Whole number as a double, so that any length of digits can be clamped."""
    return _number(text, INT_PATTERN)


def clamp(x: Column, low, high) -> Column:
    """Clamp that lets NaN and NULL through; Spark's ``least`` and ``greatest``
    alone order NaN highest and skip NULL."""
    within = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(within)


def _bad(text: Column, value: Column) -> Column:
    return text.isNotNull() & value.isNull()


def normalise_params(
    df: DataFrame,
    mode: str = "lenient",
    conf_raw: str = "conf_raw",
    alpha_raw: str = "alpha_raw",
    outline_raw: str = "outline_raw",
) -> DataFrame:
    """Add typed ``conf``, ``alpha`` (double) and ``outline`` (int) columns.

    Strict mode also adds ``error``, the first bad text of the row; its values
    are then NULL. Whole numbers beyond 32 bits are brought to the nearest int.
    """
    texts = [F.col(conf_raw), F.col(alpha_raw), F.col(outline_raw)]
    values = [parse_float(texts[0]), parse_float(texts[1]), parse_int(texts[2])]
    defaults = (DEFAULT_CONF, DEFAULT_ALPHA, float(DEFAULT_OUTLINE))
    names = ("conf", "alpha", "outline")
    if mode == "strict":
        error = F.coalesce(
            *(
                F.when(_bad(t, v), F.concat(F.lit(f"invalid {n} value: "), t))
                for n, t, v in zip(names, texts, values)
            )
        )
        columns = {
            n: F.when(error.isNull(), F.coalesce(v, F.lit(d)))
            for n, v, d in zip(names, values, defaults)
        }
        columns["error"] = error
    elif mode == "lenient":
        ranges = (CONF_RANGE, ALPHA_RANGE, OUTLINE_RANGE)
        ok = ~(_bad(texts[0], values[0]) | _bad(texts[1], values[1]) | _bad(texts[2], values[2]))
        columns = {
            n: clamp(
                F.when(ok, F.coalesce(v, F.lit(d))).otherwise(F.lit(d)), float(lo), float(hi)
            )
            for n, v, d, (lo, hi) in zip(names, values, defaults, ranges)
        }
    else:
        raise ValueError(f"unknown mode: {mode}")
    columns["outline"] = clamp(columns["outline"], *INT_RANGE).cast("int")
    return df.withColumns(columns)


def colour_error(text: Column) -> Column:
    """Message for a text that is no colour; NULL for a good or a missing one."""
    return F.when(~text.rlike(COLOUR_PATTERN), F.lit(COLOUR_MESSAGE))


def normalise_colour(df: DataFrame, mode: str = "lenient", colour_raw: str = "colour_raw") -> DataFrame:
    """Add ``colour``, by default the usual one where the text is missing.

    A bad text is NULL in lenient mode. In strict mode it is the ``error`` of its row, unless
    the row has one already, and the other rows go on.
    """
    text = F.col(colour_raw)
    usual = F.struct(*(F.lit(v).alias(n) for n, v in zip("bgr", DEFAULT_COLOUR)))
    typed = df.withColumn("colour", F.when(text.isNull(), usual).otherwise(parse_colour(text)))
    if mode == "lenient":
        return typed
    if mode != "strict":
        raise ValueError(f"unknown mode: {mode}")
    known = [F.col("error")] if "error" in df.columns else []
    return typed.withColumn("error", F.coalesce(*known, colour_error(text)))


def parse_colour(text: Column, mode: str = "lenient") -> Column:
    """``"B,G,R"`` to a struct of channels clamped to 0..255.

    Anything but three whole numbers is NULL; strict mode ends the job on it. To
    have it as an error of its row, see ``normalise_colour``.
    """
    channels = (
        clamp(
            F.regexp_replace(F.regexp_extract(text, COLOUR_PATTERN, i), "_", "").try_cast("double"),
            0.0,
            255.0,
        )
        .cast("int")
        .alias(n)
        for i, n in enumerate("bgr", start=1)
    )
    valid = text.rlike(COLOUR_PATTERN)
    parsed = F.when(valid, F.struct(*channels))
    if mode == "lenient":
        return parsed
    return F.when(~valid, F.raise_error(F.lit(COLOUR_MESSAGE))).otherwise(parsed)
