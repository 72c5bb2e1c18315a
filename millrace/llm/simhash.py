"""SimHash near-duplicate groups by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.
The Manhattan distance of two such vectors never exceeds the fingerprints'
Hamming distance, so it is a safe lower bound.  The grid has a cell for each value
of the 16 counts of one half of the axes.  Vectors within distance 3 are within
distance 1 in one of the two halves at least, so they lie there in one cell or in
two cells that are neighbours along one axis.  Each fingerprint is put into its own
cell of either half and reaches into the neighbour above it along each axis, and so
the two of any linking pair meet in a cell.  There the Manhattan bound is tested
over all axes first, then the fingerprints themselves.

Fingerprints are made distinct before the join, so copies cost nothing, and a
cell hands on a spanning forest of its links and not all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, joined, own_columns, without
from .components import connected_components, spanning_forest

SEED = 42
BITS = 64
#: Axes of a half, and the bits that hold their counts.
HALF = 16
HALVES = ((1 << 2 * HALF) - 1, -(1 << 2 * HALF))
#: Texts that are held as Python objects at a time.
SLICE = 500
#: Rows of a cell that are compared at once; larger cells go block by block.
BLOCK = 2048
#: A fingerprint of over one part in HEAVY of all rows is heavy. There are fewer than HEAVY of these, so their list is broadcast.
HEAVY = 10_000

_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)
_LOW = 0x5555555555555555


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words of the text with A-Z lower-cased, repeats included.

    Fewer words: the whole sequence is the one shingle; none: no hash.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - width]).tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, stops)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half the hashes; no hashes: 0."""
    n = len(hashes)
    if not n:
        return 0
    spread = _SPREAD[np.ascontiguousarray(hashes).view(np.uint8).reshape(n, 8)]
    # byte lanes hold at most 255, so rows are added in runs of 255 before they are widened
    sums = np.add.reduceat(spread, np.arange(0, n, 255), axis=0)
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, row_col: str | None = None) -> DataFrame:
    """(id, fp[, row]) for each row; fp is the fingerprint as a signed long.  Null text has fingerprint 0."""
    more = {"row": row_col} if row_col else {}

    def batches(it):
        for b in it:
            # texts become Python objects a slice at a time
            fp = [fingerprint(shingle_hashes(t, width)) for lo in range(0, b.num_rows, SLICE) for t in b.column("text").slice(lo, SLICE).to_pylist()]
            yield pa.record_batch([b.column("id"), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), *(b.column(c) for c in more)], names=["id", "fp", *more])

    kind = docs.schema[id_col].dataType.simpleString()
    return own_columns(docs, id=id_col, text=text_col, **more).mapInArrow(batches, f"id {kind}, fp long" + (", row long" if more else ""))


def _counts(fp: F.Column) -> F.Column:
    """Bit counts of the 32 two-bit segments, each in the segment's own two bits."""
    upper = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(upper).bitwiseAND(F.lit(_LOW))
    two = fp.bitwiseAND(upper).bitwiseAND(F.lit(_LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def _cells() -> F.Column:
    """For each half, the own cell of the column fp, and the cells reached: one count of the half higher by one."""
    out = []
    for half, mask in enumerate(HALVES):
        cell = _counts(F.col("fp")).bitwiseAND(F.lit(mask))
        at = lambda c, reached: F.struct(F.lit(half).alias("half"), c.alias("cell"), F.lit(reached).alias("reached"))  # noqa: B023, E731
        out.append(at(cell, False))
        for j in range(half * HALF, (half + 1) * HALF):
            count = F.shiftrightunsigned(cell, 2 * j).bitwiseAND(F.lit(3))
            step = lambda bits: cell.bitwiseXOR(F.lit(_signed_bits(bits << 2 * j)))  # noqa: B023, E731
            out.append(F.when(count == 0, at(step(1), True)).when(count == 1, at(step(3), True)))
    return F.array_compact(F.array(*out))


def _signed_bits(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _within(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Whether x and y link: the Manhattan bound on segment counts, then the bits themselves."""
    low = np.uint64(_LOW)
    one = np.uint64(1)
    differ = (((x ^ (x >> one)) & low) | ((x & (x >> one) & low) << one)) ^ (((y ^ (y >> one)) & low) | ((y & (y >> one) & low) << one))
    by_one = differ & low  # counts of unlike parity differ by one, other unlike counts are 0 and 2
    bound = np.bitwise_count(by_one) + 2 * np.bitwise_count((differ >> one) & low & ~by_one)
    near = bound <= radius
    near[near] = np.bitwise_count(x[near] ^ y[near]) <= radius
    return near


def _cell_links(fp: np.ndarray, reached: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one cell, block against block; those that reached into it aren't compared with one another."""
    own, all_ = np.unique(fp[~reached]), np.unique(fp)
    a: list[np.ndarray] = [np.empty(0, np.uint64)]
    b: list[np.ndarray] = [np.empty(0, np.uint64)]
    for i in range(0, len(own), BLOCK):
        for j in range(0, len(all_), BLOCK):
            p, q = own[i : i + BLOCK], all_[j : j + BLOCK]
            x, y = np.nonzero(_within(np.repeat(p, len(q)), np.tile(q, len(p)), radius).reshape(len(p), len(q)))
            f, g = spanning_forest(p[x], q[y])
            a.append(f)
            b.append(g)
    return spanning_forest(np.concatenate(a), np.concatenate(b))


def _scan_cells(radius: int):
    """Read rows sorted by cell as a stream and give each batch's links; a cell cut by a batch border is held over."""

    def links(key, fp, reached):
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
        size = np.diff(cut)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        run_end = np.repeat(cut[1:], size)
        small = np.repeat(size <= 32, size)
        for d in range(1, 32):
            i = np.flatnonzero(small[: len(fp) - d] & (np.arange(len(fp) - d) + d < run_end[: len(fp) - d])) if d < len(fp) else np.empty(0, int)
            if not len(i):
                break
            i = i[~(reached[i] & reached[i + d])]
            i = i[_within(fp[i], fp[i + d], radius)]
            found.append((fp[i], fp[i + d]))
        for k in np.flatnonzero(size > 32):
            found.append(_cell_links(fp[cut[k] : cut[k + 1]], reached[cut[k] : cut[k + 1]], radius))
        if found:
            return spanning_forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
        return np.empty(0, np.uint64), np.empty(0, np.uint64)

    def batches(it):
        held: list[tuple] = []

        def flush(parts):
            key, fp, reached = (np.concatenate([p[k] for p in parts]) for k in range(3))
            u, v = links(key, fp, reached)
            if len(u):
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in it:
            if not b.num_rows:
                continue
            key = np.stack([b.column("half").to_numpy().astype(np.int64), b.column("cell").to_numpy()], axis=1)
            part = (key, b.column("fp").to_numpy().view(np.uint64), b.column("reached").to_numpy(zero_copy_only=False))
            last = int(np.argmax((key == key[-1]).all(axis=1)))  # rows are sorted: where the last cell begins
            if last or (held and (held[-1][0][-1] != key[0]).any()):
                yield from flush([*held, tuple(x[:last] for x in part)])
                held = []
            held.append(tuple(x[last:] for x in part))
        if held:
            yield from flush(held)

    return batches


def fingerprint_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) between fingerprints that connect whatever lies within `radius` bits, 3 at most; distinct has fp long, once each."""
    rows = distinct.select("fp", F.explode(_cells()).alias("c")).select("fp", "c.half", "c.cell", "c.reached")
    dealt = rows.repartition("half", "cell").sortWithinPartitions("half", "cell")
    return dealt.mapInArrow(_scan_cells(radius), "u long, v long")


def _grouped(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, group) of the fingerprints of marked; group is the least fingerprint, as a long, that is reachable."""
    distinct = checkpointed(marked.select("fp").distinct())
    groups = connected_components(fingerprint_links(distinct, radius), contracted=True).withColumnRenamed("node", "fp")
    return distinct.join(groups, "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component_id) per row of docs.

    component_id is the smallest id reachable over links of at most `radius`
    bits, the row's own included.  Null and empty texts have fingerprint 0 and
    link like any other; repeated rows share their fingerprint; ids may be of any
    type that has an order; rows without an id link, but a null is a component's
    id only where it has no other.  An empty table gives an empty result.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, width))
    by_fp = marked.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    members = checkpointed(by_fp.join(_grouped(marked, radius), "fp"))
    lowest = members.groupBy("group").agg(F.min("low").alias("component_id"), F.count("*").alias("fps"))
    classes = joined(members, lowest, "group", F.col("fps") * HEAVY > members.count()).select("fp", "component_id", "n")
    heavy = F.col("n") * HEAVY > marked.count()
    return joined(marked, checkpointed(classes), "fp", heavy).select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate group: that of the smallest id, null ids last.

    Rows are told apart by all their columns but maps, so ids may be null or repeated.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])
    rows = docs.withColumn("__row", whole)
    marked = checkpointed(fingerprints(rows, id_col, text_col, width, "__row"))
    groups = checkpointed(_grouped(marked, radius))
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"))
    by_fp = checkpointed(marked.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")).join(groups, "fp"))
    firsts = by_fp.groupBy("group").agg(F.min("first").getField("c").alias("first_row"), F.count("*").alias("fps"))
    members = joined(by_fp.select("fp", "group", "n"), firsts, "group", F.col("fps") * HEAVY > by_fp.count())
    members = checkpointed(members.select("fp", "n", "first_row"))
    heavy = F.col("n") * HEAVY > marked.count()
    others = joined(marked, members, "fp", heavy).where("row != first_row").select(F.col("row").alias("__row")).distinct()
    kept = without(rows, others, "__row")
    # a first row that occurs several times itself
    twice = marked.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").join(firsts.select(F.col("first_row").alias("row")), "row", "left_semi")
    if not twice.isEmpty():
        kept = kept.dropDuplicates(["__row"])
    return kept.drop("__row")
