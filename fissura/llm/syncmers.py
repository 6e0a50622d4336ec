"""Document fingerprints of closed syncmers, in DataFrame functions alone.

Every run of ``K`` words holds ``SPAN`` shorter runs of two words. It is an
anchor if the smallest hash among these is that of the first or of the last.
Whether a run is an anchor depends on its own words only, so an edit moves no
anchor that it does not touch. The fingerprint lists the anchors in order, each
with 32 bits of its hash and its place, the number of words before it. Two
fingerprints are compared twice, with and without the places: an anchor that
only moved counts half. Places are compared after the fingerprints are laid
over each other, by the difference of places that most anchors share, so words put
in front of a text move nothing.

Nine words have few anchors or none. Up to ``SHORT`` words a fingerprint also
lists every word in the same way, and two such are compared by words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 8  # two-word runs in an anchor
K = SPAN + 1  # its words
# Words up to which a text is compared by words. One without an anchor has fewer
# than 2 * SPAN, so in words it is less than half like any text beyond this.
SHORT = 6 * SPAN
PLACE = (1 << 31) - 1  # bits of a place
BUCKET_ROWS = 2000
MOST_BUCKETS = 4096
GROUP = 64  # bucket limits are looked up in two steps of this size

_SPACE = r" \t\n\x0B\f\r"


def _pairs(a: str, d: int, combine) -> Column:
    """combine(a[i], a[i + d]) for every i that has both."""
    n = F.greatest(F.size(a) - d, F.lit(0))
    return F.zip_with(F.slice(F.col(a), F.lit(1), n), F.slice(F.col(a), F.lit(d + 1), n), combine)


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out array<bigint>``: of each anchor of ``text``, hash * 2**32 + place.

    ``{out}_words`` gives the words in the same form, null above ``SHORT`` of them.
    Columns that begin with ``_`` are used on the way.
    Each array is a column that later ones use more than once, so it is made
    once and no lambda makes it again.
    """
    hashed = lambda x, y: F.xxhash64(x, y)
    least = lambda x, y: F.least(x, y)
    kept = df.columns
    trimmed = F.regexp_replace(F.col(text), f"^[{_SPACE}]+|[{_SPACE}]+$", "")
    df = df.withColumn("_t", trimmed)
    words = F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", f"[{_SPACE}]+"))
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_s", _pairs("_h", 1, hashed))  # two words
    df = df.withColumn("_m2", _pairs("_s", 1, least)).withColumn("_k4", _pairs("_s", 2, hashed))
    df = df.withColumn("_m4", _pairs("_m2", 2, least)).withColumn("_k8", _pairs("_k4", 4, hashed))
    df = df.withColumn("_m8", _pairs("_m4", 4, least))
    n = F.size("_m8")
    part = lambda a, d: F.slice(F.col(a), F.lit(d + 1), n)
    at_left = F.zip_with(F.col("_m8"), part("_s", 0), lambda x, y: x == y)
    at_right = F.zip_with(F.col("_m8"), part("_s", SPAN - 1), lambda x, y: x == y)
    whole = F.zip_with(part("_k8", 0), part("_h", K - 1), hashed)
    edge = F.zip_with(at_left, at_right, lambda x, y: x | y)
    marked = F.zip_with(edge, whole, lambda e, x: F.when(e, x))
    place = lambda x, i: F.shiftleft(x, 32).bitwiseOR(i.cast("bigint"))
    df = df.withColumn(out, F.array_compact(F.transform(marked, place)))
    words = F.when(F.size("_h") <= SHORT, F.transform(F.col("_h"), place))
    return df.withColumn(f"{out}_words", words).select(*kept, out, f"{out}_words")


def written(own: str) -> Column:
    """16 hexadecimal digits an anchor; of short texts also a slash and 16 digits a word."""
    digits = lambda c: F.array_join(F.transform(c, lambda a: F.lower(F.lpad(F.hex(a), 16, "0"))), "")
    words = F.when(F.size(f"{own}_words") > 0, F.concat(F.lit("/"), digits(f"{own}_words")))
    return F.concat(digits(own), F.coalesce(words, F.lit("")))


def _dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def commonest_shift(a: str, b: str) -> Column:
    """The difference of places, b's less a's, that most hashes of both have at their first place.

    Of equally common ones the smallest, first in size; 0 where no hash is in both.
    Both arrays are sorted as one, with a's places turned round: where a hash of a
    meets the same of b, the first places of either stand side by side.
    """
    turned = F.transform(a, lambda x: x.bitwiseXOR(F.lit(PLACE)))
    after = F.transform(b, lambda x: x.bitwiseOR(F.lit(PLACE + 1)))
    place = lambda x: x.bitwiseAND(F.lit(PLACE))
    of_b = lambda x: x.bitwiseAND(F.lit(PLACE + 1)) != 0
    meet = lambda x, y: (F.shiftright(x, 32) == F.shiftright(y, 32)) & ~of_b(x) & of_b(y)
    step = lambda x, y: F.when(meet(x, y), place(y) - (F.lit(PLACE) - place(x)))

    def count(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        closer = (run == acc["most"]) & (F.abs(x) < F.abs(acc["shift"]))
        better = (run > acc["most"]) | closer
        return F.struct(
            x.alias("last"), run.alias("run"),
            F.when(better, x).otherwise(acc["shift"]).alias("shift"),
            F.when(better, run).otherwise(acc["most"]).alias("most"),
        )

    start = F.struct(
        F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"),
        F.lit(0).cast("bigint").alias("shift"), F.lit(0).alias("most"),
    )
    # The arrays are bound once, so that slices of the sorted one don't sort again.
    sorted_once = F.transform(F.array(F.sort_array(F.concat(turned, after))), lambda s: F.sort_array(
        F.array_compact(F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.size(s)), step))
    ))
    return F.aggregate(F.get(sorted_once, F.lit(0)), start, count, lambda acc: acc["shift"])


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with ``out``, 0 to 1, of the fingerprints ``a`` and ``b``; 1 for equal ones.

    Two texts of up to ``SHORT`` words are compared by words, others by anchors.
    """
    kept = df.columns
    by_words = F.col(f"{a}_words").isNotNull() & F.col(f"{b}_words").isNotNull()
    df = df.select("*", *(
        F.when(by_words, F.col(f"{c}_words")).otherwise(F.col(c)).alias(name) for c, name in ((a, "_p"), (b, "_q"))
    ))
    df = df.withColumn("_d", commonest_shift("_p", "_q"))
    # The shift is named twice, so it stays a column and is not made for each anchor.
    moved = F.when(F.col("_d") == 0, F.col("_q")).otherwise(F.transform("_q", lambda x: x - F.col("_d")))
    hashes = lambda c: F.array_distinct(F.transform(c, lambda x: F.shiftright(x, 32)))
    like = (_dice(F.col("_p"), moved) + _dice(hashes("_p"), hashes("_q"))) / 2
    return df.withColumn(out, like).select(*kept, out)


def _bucket(doc_id: Column, limits: list[int]) -> Column:
    """How many limits are below the id; a null id is below all."""
    below = lambda values: F.size(F.filter(values, lambda x: x < doc_id))
    longs = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    groups = [limits[i : i + GROUP] for i in range(0, len(limits), GROUP)]
    full = below(longs([g[-1] for g in groups[:-1]]))
    within = below(F.get(F.array(*map(longs, groups)), full))
    return F.coalesce(full * GROUP + within, F.lit(0))


def with_next(df: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``_copy`` rows added and ``_bucket``, for windows over neighbours.

    Buckets are ranges of ids of about equal numbers of rows. The first row of
    each, in descending order, also goes to the end of the bucket before it, and
    the very first to the end of the last bucket.
    """
    sizes = df.agg(F.count("*"), F.max("doc_id")).first()
    if sizes[1] is None:
        return df.select("doc_id", "text", F.lit(0).alias("_copy"), F.lit(0).alias("_bucket"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(MOST_BUCKETS, max(4 * parts, sizes[0] // BUCKET_ROWS), sizes[0] // 8))
    cuts = df.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n)], 20 * n)).first()[0]
    limits = sorted({*cuts, sizes[1]})
    here = df.select("doc_id", "text", F.lit(0).alias("_copy"), _bucket(F.col("doc_id"), limits).alias("_bucket"))
    first = here.filter(F.col("doc_id").isin(limits)).select(
        "doc_id", "text", F.lit(1).alias("_copy"), ((F.col("_bucket") + 1) % len(limits)).alias("_bucket")
    )
    return here.union(first)


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Every row is compared with its edited text and with the next row by
    descending id (after the last: the first). Rows of equal id follow in order
    of text. A null text is empty; null ids come last; where all ids are null
    or there is one row, the next of a bucket's last row is itself. A text
    without words has an empty fingerprint, like 1 to another such and 0 to
    others. An empty table gives no rows. Other columns are ignored. Texts are
    shuffled once, in ranges of ids.
    """
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("_bucket").orderBy("_copy", F.col("doc_id").desc_nulls_last(), "text")
    rows = with_next(texts).withColumn("next_text", F.coalesce(F.lead("text").over(order), F.col("text")))
    rows = with_anchors(rows, "text", "own")
    following = (F.coalesce(F.lead("_own").over(order), F.col("_own"))).alias("_next")
    rows = rows.withColumn("_own", F.struct("own", "own_words")).select("*", following).filter("_copy = 0")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)
    )
    rows = rows.select(
        "doc_id", "n_chars", "own", "own_words", edited.alias("edited"),
        F.col("_next.own").alias("next"), F.col("_next.own_words").alias("next_words"),
    )
    rows = with_anchors(rows, "edited", "new")
    rows = with_likeness(with_likeness(rows, "own", "new", "near_edited"), "own", "next", "near_next")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("own").alias("fingerprint"), written("new").alias("edited_fingerprint"), "near_edited", "near_next",
    )
