"""Merkle manifest of a table: one leaf a row, one tree a language, one root.

Bitmap ranks give every leaf its place without a sort. Ids of a language become
words of 64 bits, made by ``bit_or``, which combines on the map side; only words
that hold an id are kept. A directory of popcounts over the words, added up by
prefixes of the word number, says how many leaves come before a word, and the
bits below an id's own say the rest. A place is then the key of a slot: ``SLOTS``
consecutive slots make one array, whose levels are reduced in one go, so a tree
of a thousand million leaves takes three steps. Going down again, each array
gets the siblings above it and gives every slot its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fissura.llm.ranks import places, prefix_sums
from fissura.llm.shared import stored

SLOTS = 1 << 10  # nodes in an array, at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TIE_BITS = 60  # of a leaf, that order rows of one id


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """Hash of a row's fields, each with its length in bytes, so that no two rows read alike."""
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _depth(n: int, arity: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels, width = 0, 1
    while width < n:
        width *= arity
        levels += 1
    return levels


def _levels(nodes: list[str], steps: int, arity: int) -> list[list[str]]:
    found = [nodes]
    for _ in range(steps):
        last = found[-1]
        found.append([_hash("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return found


def _siblings(levels: list[list[str]], arity: int) -> list[list[tuple[str, str]]]:
    """Per level and node, what stands before and after it in its run of ``arity``."""
    found = []
    for nodes in levels[:-1]:
        row = []
        for i in range(len(nodes)):
            start = i - i % arity
            row.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + arity])))
        found.append(row)
    return found


class _Shape:
    """Arity, and how many levels an array of slots spans at a step."""

    def __init__(self, arity: int):
        self.arity = arity
        self.span = max(1, _depth(SLOTS + 1, arity) - 1)
        self.slots = arity**self.span

    def steps(self, total: int, step: int) -> int:
        return max(0, min(self.span, _depth(total, self.arity) - step * self.span))


def _map_rows(df: DataFrame, each: Callable[[dict], Iterable[tuple]], schema: str, kinds: list) -> DataFrame:
    """``each`` gives the result rows of a row, an array of slots; a batch a row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows = list(each(batch.slice(at, 1).to_pylist()[0]))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def _arrays(nodes: DataFrame, shape: _Shape, *more: str) -> DataFrame:
    """Nodes ``tree, total, place, node`` (and ``until``, the last place of equal ones) by array."""
    slot = F.lit(shape.slots).cast("bigint")
    first, last = F.call_function("div", "place", slot), F.call_function("div", "until", slot)
    entry = F.struct("place", "until", "node", *more)
    spread = nodes.select("tree", "total", entry.alias("entry"), F.explode(F.sequence(first, last)).alias("at"))
    return spread.groupBy("tree", "total", "at").agg(F.sort_array(F.collect_list("entry")).alias("entries"))


def _filled(row: dict, shape: _Shape) -> list[dict]:
    """The entry of every slot of the array; equal nodes stand in one entry."""
    low = row["at"] * shape.slots
    out = []
    for e in row["entries"]:
        n = min(e["until"], low + shape.slots - 1) - max(e["place"], low) + 1
        out.extend([e] * n)
    return out


def _raised(arrays: DataFrame, shape: _Shape, step: int) -> DataFrame:
    """The node above each array."""

    def each(row):
        nodes = [e["node"] for e in _filled(row, shape)]
        yield row["tree"], row["total"], row["at"], row["at"], _levels(nodes, shape.steps(row["total"], step), shape.arity)[-1][0]

    schema = "tree string, total long, place long, until long, node string"
    return _map_rows(arrays, each, schema, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()])


def _tree(nodes: DataFrame, largest: int, shape: _Shape) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of every step, and the tops ``tree, total, place, until, node``."""
    steps = max(1, -(-_depth(largest, shape.arity) // shape.span))
    arrays, more = [], [c for c in nodes.columns if c not in ("tree", "total", "place", "until", "node")]
    for step in range(steps):
        arrays.append(stored(_arrays(nodes, shape, *more), "arrays"))
        nodes, more = stored(_raised(arrays[-1], shape, step), "nodes"), []
    return arrays, nodes


_PATH = "before array<string>, after array<string>, subroot string, root string"
_PATH_KINDS = [pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]


def _local(row: dict, shape: _Shape, step: int) -> Iterator[tuple[int, dict, list, list]]:
    """Per slot: its place, its entry, and its siblings from here to the top."""
    entries = _filled(row, shape)
    around = _siblings(_levels([e["node"] for e in entries], shape.steps(row["total"], step), shape.arity), shape.arity)
    for i, entry in enumerate(entries):
        mine = [level[i // shape.arity**k] for k, level in enumerate(around)]
        before = [b for b, _ in mine] + row["before"]
        yield row["at"] * shape.slots + i, entry, before, [a for _, a in mine] + row["after"]


def _lowered(arrays: DataFrame, paths: DataFrame, shape: _Shape, step: int) -> DataFrame:
    """Paths ``tree, at`` of the nodes of these arrays, which name the arrays of the step below."""

    def each(row):
        for place, _, before, after in _local(row, shape, step):
            yield row["tree"], place, before, after, row["subroot"], row["root"]

    joined = arrays.join(paths, ["tree", "at"])
    return _map_rows(joined, each, f"tree string, at long, {_PATH}", [pa.string(), pa.int64(), *_PATH_KINDS])


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``total``, ``place`` and ``until``, the places of their copies."""
    words = F.shiftright("doc_id", 6)
    lowest, highest = leaves.agg(F.min(words), F.max(words)).first()
    lowest = (0 if lowest is None else lowest) - 1  # a null id comes first
    highest = lowest if highest is None else highest
    leaves = leaves.withColumns(
        {
            "word": F.coalesce(words, F.lit(lowest).cast("bigint")),
            "bit": F.coalesce(F.col("doc_id").bitwiseAND(63).cast("int"), F.lit(0)),
        }
    )
    ids = leaves.groupBy("tree", "word", "bit").agg(F.sum("copies").alias("n"), F.count("*").alias("kinds"))
    more = F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more")))
    bitmap = ids.groupBy("tree", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("n"),
        F.collect_list(more).alias("repeats"), F.max("kinds").alias("kinds"),
    )
    bitmap = stored(bitmap, "bitmap")
    totals = bitmap.groupBy("tree").agg(F.sum("n").alias("total"))
    directory = prefix_sums(bitmap, ["tree"], "word", "n", lowest, highest).drop("n")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))").cast("bigint")
    repeated = F.aggregate(
        "repeats", F.lit(0).cast("bigint"),
        lambda sum_, r: sum_ + F.when(r["bit"] < F.col("bit"), r["more"]).otherwise(0),
    )
    place = F.col("before") + below + repeated
    ranked = leaves.join(directory, ["tree", "word"]).withColumn("place", place)
    if not bitmap.filter("kinds > 1").isEmpty():
        # Rows of one id that differ: the same directory, over the first bits of their leaves.
        tied = leaves.join(bitmap.filter("kinds > 1").select("tree", "word"), ["tree", "word"], "left_semi")
        digits = TIE_BITS // 4
        tie = F.conv(F.substring("node", 1, digits), 16, 10).cast("bigint")
        group = ["tree", "word", "bit"]
        counts = stored(tied.groupBy(*group, tie.alias("tie")).agg(F.sum("copies").alias("n")), "ties")
        earlier = prefix_sums(counts, group, "tie", "n", 0, (1 << TIE_BITS) - 1).drop("n")
        within = Window.partitionBy(*group, "tie").orderBy("node", "changed").rowsBetween(Window.unboundedPreceding, -1)
        ranked = (
            ranked.withColumn("tie", tie)
            .join(earlier.withColumnRenamed("before", "earlier"), [*group, "tie"], "left")
            .withColumn("same", F.when(F.col("earlier").isNotNull(), F.sum("copies").over(within)))
            .withColumn("place", F.expr("place + coalesce(earlier, 0) + coalesce(same, 0)"))
        )
    return ranked.join(totals, "tree").select(
        "tree", "total", "place", (F.col("place") + F.col("copies") - 1).alias("until"), "node", "doc_id", "changed"
    )


def manifest(docs: DataFrame, tampered: Column, arity: int = 2) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Leaves of a language ascend by ``doc_id``, a null id first; rows of one id
    ascend by their leaf, and equal rows are leaves of their own. A null ``lang``
    is a language. Nulls and empty texts hash differently; texts are hashed
    whole. ``tampered`` says whose ``n_chars`` is changed before it is checked.
    Columns other than the five hashed are ignored. An empty table gives no rows.
    """
    shape = _Shape(arity)
    # In decimal, so that the largest long has a successor.
    changed = leaf_hash(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    touched = tampered & F.col("n_chars").isNotNull()
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id",
        leaf_hash().alias("node"), F.when(touched, changed).alias("changed"),
    )
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    leaves = stored(rows.groupBy("tree", "doc_id", "node", "changed").agg(F.count("*").alias("copies")), "leaves")
    nodes = _placed(leaves)
    largest = leaves.groupBy("tree").agg(F.sum("copies").alias("n")).agg(F.max("n")).first()[0] or 0
    arrays, tops = _tree(nodes, largest, shape)

    # The languages' subroots, in their order, are the leaves of the last tree.
    ordered = stored(places(tops.select(F.col("tree").alias("of"), "node"), "of"), "subroots")
    n_trees = ordered.count()
    subroots = ordered.select(
        F.lit("").alias("tree"), F.lit(n_trees).cast("bigint").alias("total"), "place", F.col("place").alias("until"), "node", "of",
    )
    upper, roots = _tree(subroots, n_trees, shape)
    none = F.array().cast("array<string>")
    paths = roots.select(
        "tree", F.col("place").alias("at"), none.alias("before"), none.alias("after"),
        F.lit("").alias("subroot"), F.col("node").alias("root"),
    )
    for step in reversed(range(len(upper))):
        paths = _lowered(upper[step], paths, shape, step)
    named = paths.drop("tree", "subroot").join(ordered.withColumnRenamed("place", "at"), "at")
    paths = named.select(
        F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("at"), "before", "after", F.col("node").alias("subroot"), "root",
    )
    for step in reversed(range(1, len(arrays))):
        # Stored, so that its size is known before it is joined: a row becomes an array's slots.
        paths = stored(_lowered(arrays[step], paths, shape, step), "paths")

    def each(row):
        for _, entry, before, after in _local(row, shape, 0):
            folded = entry["changed"] or entry["node"]
            for left, right in zip(before, after):
                folded = _hash(left + folded + right)
            proof = _hash("".join(left + right for left, right in zip(before, after)))
            yield entry["doc_id"], entry["node"], row["subroot"], row["root"], proof, folded, folded == row["root"]

    schema = (
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    return _map_rows(arrays[0].join(paths, ["tree", "at"]), each, schema, kinds)


#: The same by sorting, one level of nodes after the other.
SQL = """
WITH RECURSIVE steps AS (
  SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), fields AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc
), leaves AS (
  SELECT doc_id, tree, head, tail, n_chars, tampered,
    sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1)::VARCHAR, '-') || tail) AS changed
  FROM fields
), placed AS (
  SELECT doc_id, tree, leaf, tampered, changed, row_number() OVER () AS id,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS node, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n
), subroots AS (
  SELECT tree, node AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, rank AS place, subroot AS node, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2
  FROM tops WHERE n > 1 GROUP BY level, place // 2, n
), siblings AS (
  SELECT p.id, s.level, s.node FROM placed p JOIN nodes s ON s.tree = p.tree AND s.place = xor(p.place >> s.level, 1)
  UNION ALL
  SELECT p.id, r.height + t.level, t.node FROM placed p JOIN subroots r ON r.tree = p.tree
    JOIN tops t ON t.place = xor(r.rank >> t.level, 1)
), proofs AS (
  SELECT id, sha256(string_agg(node, '' ORDER BY level)) AS proof FROM siblings GROUP BY id
), height AS (
  SELECT tree, height + (SELECT max(level) FROM tops) AS top, height, rank, subroot,
    (SELECT node FROM tops WHERE n = 1) AS root
  FROM subroots
), folds AS (
  SELECT id, tree, 0 AS level, place, CASE WHEN tampered THEN changed ELSE leaf END AS node FROM placed
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, (CASE WHEN f.level = h.height THEN h.rank ELSE f.place END) >> 1,
    sha256(CASE WHEN (CASE WHEN f.level = h.height THEN h.rank ELSE f.place END) & 1 = 1
      THEN coalesce(s.node, '') || f.node ELSE f.node || coalesce(s.node, '') END)
  FROM folds f JOIN height h ON h.tree = f.tree AND f.level < h.top
    LEFT JOIN siblings s ON s.id = f.id AND s.level = f.level
)
SELECT p.doc_id, p.leaf, h.subroot, h.root, coalesce(q.proof, sha256('')) AS proof_sha256, f.node AS folded_root,
  f.node = h.root AS verified
FROM placed p JOIN height h ON h.tree = p.tree LEFT JOIN proofs q ON q.id = p.id
  JOIN folds f ON f.id = p.id AND f.level = h.top
"""
