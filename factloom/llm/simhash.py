"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance of their fingerprints, so
fingerprints within LINK_BITS bits are vectors within LINK_BITS. The coordinates are dealt
into groups; vectors within 4 differ in at most 4 groups and so agree in all others, hence they
share a cell of at least one grid that is made of that many groups. How many groups there are
follows the number of fingerprints, as more groups give more grids of smaller cells. Cells are
joined, pairs are held to the Manhattan bound and then to the exact Hamming distance; a pair that
shares several cells comes from the first of them only. Links join to components by alternating
large and small stars.

Cells of equal counts take the place of a range join between neighbouring cells: a count of a two-bit segment ranges
over three values only, so neighbours would be most of the grid. Of ten million random fingerprints each meets 107 others
in its 70 cells (measured; as many are expected), of a thousand million 1,700 in 210.

Equal fingerprints are one node, so copies are never paired with each other. Nor are all near
copies: in a crowded cell each fingerprint within LINK_BITS of the cell's smallest one links to
that, which stands for the cell. Whoever is joined so needs no more links with each other: cells
whose fingerprints are all in one component are settled, and of the others only pairs between
different components are made. Components come out as if all links had been made.

Defined results: a null or blank text has fingerprint zero, linked like any other; a text of
under four words is one shingle, and a very long one is read whole. A bit that half of the shingles
set is 0. Rows with a null doc_id get a component but never name it; a component without any id
is named null. Repeated rows come out repeated. An empty table gives no rows. Other columns are
ignored by near_duplicates() and carried by deduplicated().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, slices, table, without

SHINGLE_WORDS, SEED, LINK_BITS = 4, 42, 4
#: Fewest and most groups of coordinates, and members from which on a cell is crowded.
LEAST_AXES, MOST_AXES, CROWD = 5, 11, 32
_ROOM = 1 << 16
#: Names of columns that no table has: a kept row's id and the digest of its text.
ID, DIGEST = "factloom_kept_id", "factloom_digest"


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE_WORDS, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, len(first), _ROOM):
        pairs = zip(first[a : a + _ROOM], last[a : a + _ROOM], strict=True)
        h = np.array([digest(joined[i:j], SEED) for i, j in pairs], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(first), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in slices(whole)):
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype="<u8")
        made = {"doc_id": batch.column("doc_id"), "fp": pa.array(prints.view("<i8"), pa.int64())}
        if DIGEST in batch.schema.names:
            made[DIGEST] = batch.column(DIGEST)
        yield pa.RecordBatch.from_pydict(made)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; also DIGEST, if docs has it."""
    digest = [DIGEST] if DIGEST in docs.columns else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *digest)
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long" + "".join(f", {c} binary" for c in digest))


def axes_for(n: int) -> int:
    """The number of groups that n fingerprints take least work with: a copy for each grid, and a tenth of
    that for each other one that is in its cell by chance."""

    def work(axes: int) -> float:
        # two random segments have equal counts with a chance of 3/8
        by_chance = n * (3 / 8) ** (32 * (axes - LINK_BITS) / axes)
        return math.comb(axes, LINK_BITS) * (1 + by_chance / 10)

    return min(range(LEAST_AXES, MOST_AXES + 1), key=work)


def _grids(axes: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The bit mask of each group of coordinates, and of each grid: its groups as bits, its bit mask."""
    of = np.array_split(np.arange(32), axes)
    masks = [sum(3 << int(2 * i) for i in group) for group in of]
    agree = axes - LINK_BITS
    grids = [(sum(1 << i for i in c), sum(masks[i] for i in c)) for c in combinations(range(axes), agree)]
    return masks, grids


def _first(groups: int, n: int) -> int:
    """The n lowest of the set bits."""
    return sum(1 << i for i in [i for i in range(groups.bit_length()) if groups >> i & 1][:n])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def counts_of_segments(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments in unary (00, 01, 11), packed into one long.

    The Manhattan distance of two such vectors is the number of bits in which they differ.
    """
    low = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _lit(mask: int) -> Column:
    return F.lit(_signed(mask)).cast("long")


def _placed(nodes: DataFrame, axes: int) -> DataFrame:
    """nodes with each cell (g, c) that their fp are in."""
    cells = F.array(*[F.struct(F.lit(g).alias("g"), F.col("u").bitwiseAND(_lit(m)).alias("c")) for g, m in _grids(axes)[1]])
    out = nodes.withColumn("u", counts_of_segments(F.col("fp"))).withColumn("at", F.explode(cells))
    return out.select(*nodes.columns, F.col("at.g").alias("g"), F.col("at.c").alias("c"))


def _near(a: Column, b: Column) -> Column:
    """Whether two fingerprints link: held to the Manhattan bound first."""
    bound = F.bit_count(counts_of_segments(a).bitwiseXOR(counts_of_segments(b))) <= LINK_BITS
    return bound & (F.bit_count(a.bitwiseXOR(b)) <= LINK_BITS)


def pairs(placed: DataFrame, axes: int) -> DataFrame:
    """The links (a < b) between different components of placed (fp, root, g, c), each once."""
    x, y = placed.alias("x"), placed.alias("y")
    apart = counts_of_segments(F.col("x.fp")).bitwiseXOR(counts_of_segments(F.col("y.fp")))
    # the groups in which the two agree, as bits, and for each such set its first grid
    agree = sum((F.when(apart.bitwiseAND(_lit(m)) == 0, 1 << i).otherwise(0) for i, m in enumerate(_grids(axes)[0])), F.lit(0))
    first = F.element_at(F.array(*[F.lit(_first(x, axes - LINK_BITS)) for x in range(1 << axes)]), agree + 1)
    near = (
        (F.col("x.g") == F.col("y.g"))
        & (F.col("x.c") == F.col("y.c"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (F.col("x.root") != F.col("y.root"))
        & _near(F.col("x.fp"), F.col("y.fp"))
        & (first == F.col("x.g"))
    )
    return x.join(y, near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def links(nodes: DataFrame, axes: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of the fingerprints nodes.fp, which are distinct, that have the components of all pairs
    within LINK_BITS bits; with an endless crowd these pairs themselves (a < b)."""
    axes = axes or axes_for(nodes.count())
    placed = _placed(nodes.select("fp"), axes)
    crowded = placed.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("rep")).where(F.col("n") > crowd)
    crowded = checkpoint(crowded.select("g", "c", "rep"))
    if crowded.isEmpty():
        return pairs(_placed(nodes.select("fp", F.col("fp").alias("root")), axes), axes)
    close = placed.join(crowded, ["g", "c"]).where((F.col("fp") != F.col("rep")) & _near(F.col("fp"), F.col("rep")))
    stars = checkpoint(close.select(F.col("rep").alias("a"), F.col("fp").alias("b")).distinct())
    roots = components(stars)
    rooted = nodes.select("fp").join(roots, F.col("fp") == F.col("node"), "left")
    placed = _placed(rooted.select("fp", F.coalesce("root", "fp").alias("root")), axes)
    settled = placed.join(crowded.select("g", "c"), ["g", "c"], "left_semi").groupBy("g", "c")
    settled = settled.agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low = high")
    settled = checkpoint(settled.select(F.col("g").alias("sg"), F.col("c").alias("sc")))
    live = without(placed, settled, lambda p, s: (p["g"] == s["sg"]) & (p["c"] == s["sc"]))
    return stars.unionByName(pairs(live, axes))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node that it reaches."""
    edges, before = checkpoint(edges.select("a", "b")), None
    while True:
        state = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = state
        # large star: a node's larger neighbours move to its smallest
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # small star: a node's smaller neighbours move to the smallest of them
        least = big.groupBy("b").agg(F.min("a").alias("m"))
        small = big.join(least, "b")
        moved = small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = checkpoint(moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct())


def _rooted(nodes: DataFrame, axes: int | None) -> DataFrame:
    """nodes, whose fp are distinct, with the root of each one's component."""
    roots = components(links(nodes, axes))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        *nodes.columns, F.coalesce("root", "fp").alias("root")
    )
    # written down, so that the join with a very large component can be split
    return checkpoint(rooted)


def near_duplicates(docs: DataFrame, axes: int | None = None) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    rows = checkpoint(fingerprints(docs))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    rooted = _rooted(nodes, axes)
    named = checkpoint(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, axes: int | None = None) -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns; rows are not shuffled.

    A component is known by its root, so that neither null ids nor an id on unlike texts make two
    components one. Rows without an id stay only if nothing in their component has one. Among rows
    with the smallest id the smallest fingerprint stays, then the smallest SHA-256 of the text; rows
    that are equal in both id and text come out once.
    """
    # a null text is told apart from an empty one
    digest = F.coalesce(F.unhex(F.sha2(F.col("text"), 256)), F.lit(b""))
    own = docs.withColumn(DIGEST, digest)
    rows = checkpoint(fingerprints(own))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", DIGEST)
    nodes = checkpoint(rows.groupBy("fp").agg(F.min(row).alias("least")))
    rooted = _rooted(nodes, axes)
    row = F.struct("least.no_id", "least.doc_id", "fp", f"least.{DIGEST}")
    stay = rooted.groupBy("root").agg(F.min(row).alias("row"))
    stay = stay.select(F.col("row.doc_id").alias("stay_id"), F.col(f"row.{DIGEST}").alias("stay_digest"))
    keys = rows.groupBy(F.col("doc_id").alias(ID), F.col(DIGEST).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    stays = F.col("stay_digest").isNotNull()
    same_key = (F.col("digest") == F.col("stay_digest")) & F.col(ID).eqNullSafe(F.col("stay_id"))
    keys = keys.join(stay, same_key, "left").select(ID, "digest", "n", stays.alias("stays"))
    keys = checkpoint(keys.where("n > 1 OR NOT stays"))

    def same(x: DataFrame, y: DataFrame) -> Column:
        return (x[DIGEST] == y["digest"]) & x["doc_id"].cast("long").eqNullSafe(y[ID])

    left = without(own, keys.where("NOT stays").select(ID, "digest"), same)
    again = keys.where("stays").select(ID, "digest")
    if again.isEmpty():
        return left.drop(DIGEST)
    once = left.join(again, same(left, again), "left_semi").dropDuplicates(["doc_id", DIGEST])
    return without(left, again, same).unionByName(once).drop(DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
