"""Documents whose shingle sets have a Jaccard likeness of at least num/den, as components.

Adaptive multi-match prefixes. Shingles have one global order, rare ones first.
If two sets are similar, their prefixes of ``n - ceil(t n) + l`` shingles share
at least ``l``. Each document has an ``l`` of 1 or ``LONG``: a longer prefix
costs more postings, but asks for more shared ones before a pair is verified;
the cost of both is estimated from how often the shingles occur. Of a pair, the
smaller of the two ``l`` must be shared. So ``l - 1`` of a document's published
shingles need not be looked up at all: the most frequent ones, by exact counts.
The rarest that two documents share is never among them.

1. Every task counts its shingles in ``BINS`` bins; the sums give the order.
2. Documents with equal sets become one class. A class publishes its prefix.
3. Shingles looked up by few classes give candidate pairs. The published
   shingles that a pair shares are counted against ``l``, and what is left is
   verified on the whole sets. A shingle looked up by many gives only the pairs
   with one of its classes.
4. Such large buckets may hold classes that are not connected yet. Those, the
   strays, are compared with all the bucket in blocks of bounded size, on
   bit sets, and only links between components leave a task.

No bucket is dropped or cut; its pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fissura.llm.graph import components
from fissura.llm.shared import arrow_schema, blocks, map_blocks, stored, texts_of
from fissura.llm.shingles import mix, shingle_sets

BINS = 1 << 20
PART = 4096  # bins in a row of the sketch
SMALL = 48  # classes of a bucket whose pairs are candidates
LONG = 12  # the l of a lengthened prefix
SET_CHARS = 500_000  # of text that sets are made of at a time
FEW = 8  # sketches that a step of the sum adds up
BLOCK = 256  # classes on either side of a block of a large bucket
VERIFY_COST = 20.0  # of verifying a candidate, in postings read
_U = np.uint64


def _sketch(texts: DataFrame, width: int) -> np.ndarray:
    """How often shingles of each bin occur in distinct sets, over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            column = batch.column(1)
            for begin, end in blocks(column, SET_CHARS):
                sets = shingle_sets(column.slice(begin, end - begin).to_pylist(), width)
                counts += np.bincount(_bin(np.concatenate(sets)), minlength=BINS)
        parts = [_packed(counts[a : a + PART]) for a in range(0, BINS, PART)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts))), pa.array(parts, pa.binary())], schema=types
        )

    def add(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in rows:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + _unpacked(data)
        if sums:
            data = list(map(_packed, sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(sums), pa.array(data, pa.binary())], schema=types)

    schema = "part long, data binary"
    types = arrow_schema(schema)
    parts = texts.mapInArrow(run, schema)
    # A sum is as large as what it adds up, so each step is in bounded memory: a sketch at most.
    n = texts.rdd.getNumPartitions()
    while n > FEW:
        n = -(-n // FEW)
        parts = parts.repartition(n).mapInArrow(add, schema)
    total = np.zeros(BINS, np.int64)
    for part, data in parts.collect():  # FEW sketches of fixed size at most
        at = part * PART
        total[at : at + PART] += _unpacked(data)
    return total


def _packed(counts: np.ndarray) -> bytes:
    """In 1, 2 or 4 bytes a bin; counts beyond the last are all alike."""
    for size in (1, 2, 4):
        if size == 4 or counts.max() < 1 << 8 * size:
            return np.minimum(counts, (1 << 32) - 1).astype(f"<u{size}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // PART}").astype(np.int64)


def _bin(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> _U(44)).astype(np.int64)


RANK_SCALE = 2000.0


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Counts of bins on a fine logarithmic scale."""
    return np.minimum(RANK_SCALE * np.log2(counts + 1.0), 65535).astype(np.uint16)


def prefix(one: np.ndarray, ranks: np.ndarray, noise: float, num: int, den: int) -> tuple[int, np.ndarray]:
    """(l, published shingles) of a sorted set; those of the emptiest bins come first.

    A bin's count is at least how often each of its shingles occurs. ``noise`` is
    what other shingles add to it, and is taken off where costs are estimated.
    """
    n = len(one)
    overlap = -(-num * n // den)
    rank = ranks[_bin(one)]
    order = np.argsort(rank, kind="stable")  # ties by the shingle itself
    base = n - overlap
    lengths = np.array([1, LONG] if overlap >= LONG else [1])
    often = np.maximum(np.exp2(rank[order[: base + lengths[-1]]] / RANK_SCALE) - noise, 1.0)
    reads = np.cumsum(often)[base + lengths - 1]
    cost = reads + VERIFY_COST * reads / lengths**2
    best = int(lengths[np.argmin(cost)])
    return best, one[order[: base + best]]


SETS = "doc_id long, n long, k1 long, k2 long, l int, shared array<int>"


def _sets(texts: DataFrame, width: int, counts: np.ndarray, num: int, den: int) -> DataFrame:
    """Per row: size and digest of its set, and the prefix, in 32 bits a shingle."""
    ranks = texts.sparkSession.sparkContext.broadcast((_ranks(counts), float(np.median(counts)) + 1))

    def work():
        table, noise = ranks.value

        def each(ids, texts):
            rows = []
            for one in shingle_sets(texts, width):
                if not len(one):
                    rows.append((0, 0, 0, 0, []))
                    continue
                length, some = prefix(one, table, noise, num, den)
                first = mix(one + _U(1)).sum(dtype=np.uint64)
                second = mix(one ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                short = _short(some)
                if len(short) < len(some):  # two fell together, so the count of shared ones may be short
                    length = 1
                rows.append((len(one), int(first.view(np.int64)), int(second.view(np.int64)), length, short))
            n, k1, k2, lengths, some = zip(*rows)
            return {"doc_id": ids, "n": n, "k1": k1, "k2": k2, "l": lengths, "shared": some}

        return each

    return map_blocks(texts, work, SETS, SET_CHARS).withColumn("own", F.col("doc_id"))


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart; a null text is not an empty one."""
    return F.xxhash64(text)


def _told_apart(texts: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, bool, bool]:
    """Where ids have several sets, their rows go by a hash of the set instead of the id.

    So a number stands for one set from here on; ``own`` keeps the id. Returns
    also whether there were such ids, and whether any number stands in several rows.
    """
    real = sets.filter("n > 0 and doc_id is not null")
    differ = F.expr("min(k1) <> max(k1) or min(k2) <> max(k2) or min(n) <> max(n)")
    many = real.groupBy("doc_id").agg(F.count("*").alias("times"), differ.alias("differ")).filter("times > 1")
    many = stored(many, "many")
    if many.filter("differ").isEmpty():
        return texts, sets, False, not many.isEmpty()
    named = real.join(many.filter("differ"), "doc_id", "left_semi")
    named = stored(named.select("doc_id", "text_key", F.xxhash64("k1", "k2", "n").alias("set_id")).distinct(), "named")

    def renamed(df: DataFrame) -> DataFrame:
        both = df.join(named, ["doc_id", "text_key"], "left")
        return both.withColumn("doc_id", F.coalesce("set_id", "doc_id")).select(df.columns)

    return renamed(texts), stored(renamed(sets), "sets"), True, True


def _short(shingles: np.ndarray) -> np.ndarray:
    """32 bits serve candidates: equal ones by chance cost a verification, no link."""
    return np.unique((shingles & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32))


def _bitmap(ids: DataFrame) -> tuple[int, dict[int, bytes]]:
    """A bit set of hashed ids, of bounded size; where it is dense it only passes more."""
    bits = 1 << 20
    while bits < min(16 * ids.count(), 1 << 29):
        bits *= 2
    at = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    return bits, {r["part"]: bytes(r["bits"]) for r in rows.collect()}


def may_be_among(ids: DataFrame, key: Column) -> Column:
    """False only where ``key``, a long, is surely none of ``ids (id long)``.

    A bit set of bounded size, so that rows which are in no small table need not
    be shuffled to find that out; what passes is to be joined exactly.
    """
    bits, parts = _bitmap(ids)
    shared = ids.sparkSession.sparkContext.broadcast(parts)

    @F.arrow_udf("boolean")
    def among(place: pa.Array) -> pa.Array:
        return pa.array(_set_bits(shared.value, place.to_numpy(zero_copy_only=False)))

    return among(F.pmod(F.xxhash64(key), F.lit(bits)))


def _set_bits(parts: dict[int, bytes], at: np.ndarray) -> np.ndarray:
    """Which of the places are set."""
    found, part_of = np.zeros(len(at), bool), at // 32768 + 1
    for part in np.unique(part_of).tolist():
        if part in parts:
            mine = np.flatnonzero(part_of == part)
            bit = np.unpackbits(np.frombuffer(parts[part], np.uint8), bitorder="little")
            found[mine] = bit[at[mine] % 32768] > 0
    return found


def _whole_sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, items`` of the documents in ``ids``, made again from their texts."""
    bits, parts = _bitmap(ids)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    shared = texts.sparkSession.sparkContext.broadcast(parts)
    schema = "id long, items array<long>"
    types = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for batch in batches:
            keep = _set_bits(have, batch.column(2).to_numpy())
            batch = batch.filter(pa.array(keep))
            column = batch.column(1)
            for begin, end in blocks(column, SET_CHARS):
                sets = shingle_sets(column.slice(begin, end - begin).to_pylist(), width)
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column(0).slice(begin, end - begin), "items": [s.view(np.int64) for s in sets]},
                    schema=types,
                )

    found = texts.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", place.alias("at"))
    return found.mapInArrow(run, schema).join(ids, "id", "left_semi")


def _fits(a: str, b: str, num: int, den: int):
    """Sizes that can have the likeness at all."""
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _sharing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, l) that share l published shingles at least."""
    published = classes.select(F.col("doc_id").alias("id"), "shared")
    both = pairs.join(published.select(F.col("id").alias("a"), F.col("shared").alias("x")), "a").join(
        published.select(F.col("id").alias("b"), F.col("shared").alias("y")), "b"
    )
    return both.filter(F.size(F.array_intersect("x", "y")) >= F.col("l")).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return (
        both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("s"))
        .filter(F.col("i") * den >= (F.col("s") - F.col("i")) * num)
        .select("a", "b")
    )


def _block_links(large: DataFrame, found: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components within large buckets, strays against all, in blocks."""
    # A bucket is told by shingle and level; one number will do.
    buckets = large.select(F.xxhash64("token", "level").alias("token"), "rep")
    members = stored(
        buckets.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
            "token", "rep", F.coalesce("component", "rep").alias("component")
        ),
        "members",
    )
    sizes = members.groupBy("token", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("token").agg(
        F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("all")
    )
    mixed = largest.filter("parts > 1").select(
        "token", F.col("top.component").alias("main"),
        F.ceil(F.col("all") / BLOCK).alias("columns"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("rows"),
    )
    placed = members.join(mixed, "token").withColumn("mix", F.abs(F.xxhash64("rep", "token")))
    own_row = F.pmod(F.col("mix"), F.col("rows"))
    own_column = F.pmod(F.col("mix"), F.col("columns"))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    strays = placed.filter("component <> main").select(
        "token", "rep", "component", F.lit(True).alias("stray"), own_row.alias("row"),
        F.explode(every("columns")).alias("column"),
    )
    all_ = placed.select(
        "token", "rep", "component", F.lit(False).alias("stray"), F.explode(every("rows")).alias("row"),
        own_column.alias("column"),
    )
    cells = strays.union(all_).join(sets.withColumnRenamed("id", "rep"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        stray = table.column("stray").to_numpy()
        ids, of = table.column("rep").to_numpy(), table.column("component").to_numpy()
        items = table.column("items").combine_chunks()
        counts = np.diff(items.offsets.to_numpy())
        values = items.flatten().to_numpy()
        return pa.table(
            dict(zip("ab", _similar(stray, ids, of, counts, values, num, den))),
            schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]),
        )

    return cells.groupBy("token", "row", "column").applyInArrow(compare, "a long, b long")


def _similar(stray, ids, of, counts, values, num, den) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs of a stray and another of a different component; a spanning part of them."""
    _, column = np.unique(values, return_inverse=True)
    width = -(-(int(column.max(initial=0)) + 1) // 64) * 64
    row = np.repeat(np.arange(len(ids)), counts)
    root = {c: c for c in set(of.tolist())}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    rest = np.flatnonzero(~stray)
    a, b = [], []
    common = np.zeros((int(stray.sum()), len(rest)), np.int64)
    left = np.flatnonzero(stray)
    for begin in range(0, width, 1 << 16):  # a slice of the columns, in bounded memory
        size = min(1 << 16, width - begin)
        bits = np.zeros((len(ids), size), bool)
        mine = (column >= begin) & (column < begin + size)
        bits[row[mine], column[mine] - begin] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for k, i in enumerate(left.tolist()):
            common[k] += np.bitwise_count(packed[rest] & packed[i]).sum(axis=1, dtype=np.int64)
    for k, i in enumerate(left.tolist()):
        union = counts[i] + counts[rest] - common[k]
        for j in rest[(common[k] * den >= union * num) & (of[rest] != of[i])].tolist():
            x, y = top(of[i]), top(of[j])
            if x != y:
                root[x] = y
                a.append(ids[i])
                b.append(ids[j])
    return np.asarray(a, np.int64), np.asarray(b, np.int64)


@dataclass(frozen=True)
class _Joined:
    """``rows``: ``doc_id, own, text_key, n`` of every row; ``links``: of ``doc_id``; ``renamed``: see ``_told_apart``."""

    rows: DataFrame
    links: DataFrame
    renamed: bool


def join_similar(
    df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``df``.

    Two documents link when ``den * intersection >= num * union`` of their sets
    of ``width``-word shingles; a component is named by its smallest id. A text
    with fewer words is one shingle; a null text, or one without words, has none
    and links with nothing. Repeated rows link like any copies; rows that share
    an id but not a text link under that id; a null id gets a null component.
    An empty table gives no rows; other columns are ignored.
    """
    joined = _joined(df, width, num, den, id_col, text_col)
    rows = joined.rows.select("doc_id", "own", F.col("n").alias("n_shingles"))
    if not joined.renamed:
        found = components(joined.links).withColumnRenamed("id", "doc_id")
        return rows.join(found, "doc_id", "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
        )
    real = rows.filter("n_shingles > 0 and own is not null")
    low = real.groupBy("own").agg(F.min("doc_id").alias("b"))
    same_id = real.join(low, "own").filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    found = components(joined.links.union(same_id)).withColumnRenamed("id", "doc_id")
    linked = real.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    linked = stored(linked.select("own", "component").distinct(), "linked")  # one component an id
    names = linked.groupBy("component").agg(F.min("own").alias("component_id"))
    named = linked.join(names, "component").select("own", "component_id")
    return rows.join(named, "own", "left").select(
        F.col("own").alias("doc_id"), "n_shingles", F.coalesce("component_id", "own").alias("component_id")
    )


def near_copies(
    df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Rows that have another keeper, and rows that occur repeatedly; both as ``doc_id, text_key``.

    Of each component of similar sets the row of the smallest id, and of its
    texts the one of the smallest key, is the keeper. Here rows of one id are
    apart: each goes by its own text. Of the second table, those that are not in
    the first are to be left once. Rows with a null id are in neither.
    """
    joined = _joined(df, width, num, den, id_col, text_col)
    known = joined.rows.filter("own is not null")
    found = components(joined.links).withColumnRenamed("id", "doc_id")
    if joined.renamed:
        real = known.filter("n > 0").join(found, "doc_id", "left")
        real = stored(real.select("own", "text_key", F.coalesce("component", "doc_id").alias("component")).distinct(), "parts")
        keepers = real.groupBy("component").agg(F.min(F.struct("own", "text_key")).alias("keeper"))
        gone = real.join(keepers, "component").filter(F.struct("own", "text_key") != F.col("keeper"))
    else:
        gone = known.join(found, "doc_id").filter("component <> doc_id")
    gone = gone.select(F.col("own").alias("doc_id"), "text_key").distinct()
    again = known.groupBy(F.col("own").alias("doc_id"), "text_key").agg(F.count("*").alias("times"))
    return gone, again.filter("times > 1").select("doc_id", "text_key")


def _joined(df: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> _Joined:
    key = text_key(F.col(text_col)).alias("text_key")
    texts = texts_of(df, id_col, text_col, (key,))
    sets = stored(_sets(texts, width, _sketch(texts, width), num, den), "sets")
    texts, sets, renamed, repeated = _told_apart(texts, sets)
    real = sets.filter("n > 0 and doc_id is not null")
    copies = real.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    members = real.select("doc_id", "k1", "k2", "n").join(copies.filter("copies > 1"), ["k1", "k2", "n"])
    equal = members.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    again = stored(equal.distinct(), "copies")

    classes = real.join(again.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    if repeated:
        classes = stored(classes.dropDuplicates(["doc_id"]), "classes")
    postings = classes.select(
        F.explode("shared").alias("token"), F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("n"), "l"
    )
    often = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    postings = stored(postings.join(often, "token"), "postings")

    # Level LONG: without the l - 1 most frequent. Level 1: where a side has l = 1, with all.
    by_count = Window.partitionBy("rep").orderBy(F.desc("df"), F.desc("token"))
    ranked = postings.filter(F.col("l") == LONG).withColumn("rank", F.row_number().over(by_count))
    rare = ranked.filter(F.col("rank") >= LONG).withColumn("level", F.lit(LONG))
    plain = postings.filter("l = 1").select("token").distinct()
    all_ = postings.join(plain, "token", "left_semi").withColumn("level", F.lit(1))
    keys = ["token", "level"]
    looked = [*keys, "rep", "n", "l"]
    looked_up = stored(rare.select(looked).union(all_.select(looked)), "lookups")
    sizes = looked_up.groupBy(keys).agg(F.count("*").alias("size")).filter("size > 1")
    looked_up = stored(looked_up.join(sizes, keys), "buckets")
    small, large = looked_up.filter(F.col("size") <= SMALL), looked_up.filter(F.col("size") > SMALL)

    side = lambda s: small.select(*keys, *(F.col(c).alias(c + s) for c in ("rep", "n", "l")))
    pairs = (
        side("1").join(side("2"), keys)
        .filter((F.col("rep1") < F.col("rep2")) & _fits("n1", "n2", num, den))
        .filter(F.least("l1", "l2") == F.col("level"))
        .select(F.col("rep1").alias("a"), F.col("rep2").alias("b"), F.col("level").alias("l"))
        .distinct()
    )
    first = large.groupBy(keys).agg(F.min(F.struct("rep", "n", "l")).alias("low"))
    pivots = (
        large.join(first, keys)
        .filter((F.col("rep") > F.col("low.rep")) & _fits("n", "low.n", num, den))
        .select(F.col("low.rep").alias("a"), F.col("rep").alias("b"), F.least("l", "low.l").alias("l"))
        .distinct()
    )
    pairs = stored(_sharing(pairs.union(pivots).distinct(), classes), "pairs")

    ids = (
        pairs.select(F.explode(F.array("a", "b")).alias("id")).union(large.select(F.col("rep").alias("id"))).distinct()
    )
    whole = stored(_whole_sets(texts, stored(ids, "ids"), width), "whole")
    links = stored(_verified(pairs, whole, num, den), "similar")
    if not large.isEmpty():
        found = components(links)
        links = stored(links.union(_block_links(large, found, whole, num, den)), "similar")
    return _Joined(sets.select("doc_id", "own", "text_key", "n"), links.union(again), renamed)
