"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected positions are kept: a text's words are hashed,
and a suffix is retained where its first GRAM words have the least hash of a
window.  Any run of GRAM + SPAN - 1 words holds such a place, at the same offset
wherever the run occurs, so every passage of LEAST words has a retained suffix in
each of its copies.

Texts are made distinct first; a text of several documents is a passage of its own.
A first pass gives each text's suffixes by the hash of their first words alone and
keeps those that occur again.  The texts that hold one are then read again, and each
kept suffix takes along the words before and behind it, as far as the windows reach
that it was selected for.  Suffixes with the same first words meet in a task, are
sorted in suffix order, word by word, and compared with their neighbours there;
sorted by the words before them, read backwards, they are compared with their
neighbours again.  A match is what the two common stretches, extended left and
right, add up to.  Hashes only deal the suffixes out; words decide.

A very common hash is not gathered: its windows, each with a 128-bit digest of its
words, are sorted over all tasks and compared with their neighbours, and what a
task's first and last window have in other tasks is added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, joined, merged_ranges, own_columns, remove, scratch
from .components import connected_components, spanning_forest

#: Least words of a passage; words of a suffix's hash; hashes of a window of which the least is selected.
LEAST, GRAM = 50, 8
SPAN = LEAST - GRAM + 1
#: Suffixes of one hash that are compared in one task; of more, their windows are sorted over all tasks.
HOT = 2_000
#: A hash with over one part in HEAVY of all suffixes is heavy. There are fewer than HEAVY of these, so their list is broadcast.
HEAVY = 10_000

#: Rows that a task hands on at a time, but for its last text's.
ROWS = 4_000

FOUND = "key long, start long, end long, within boolean, other long"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words, split at ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by place."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    # h is split into a sum over powers of an odd base: doubling over the bits of n
    out, width, power = np.zeros(len(h) + 1, dtype=np.uint64), 0, _BASE
    block, size, scale = h.copy(), 1, power
    total = np.zeros(len(h) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        while size <= n:
            if n & size:
                total = total * scale + block[width : width + len(total)]
                width += size
            if 2 * size <= n:
                block = block[: len(block) - size] * scale + block[size:]
                scale = scale * scale
            size *= 2
    return _mixed(total)


def minima(grams: np.ndarray, span: int) -> np.ndarray:
    """The least hash of each window of `span` hashes, by the window's place; of all, where there are fewer."""
    span = min(span, len(grams))
    low, size = grams.copy(), 1
    while 2 * size <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - (span - size)], low[span - size :]) if size < span else low


def selected(grams: np.ndarray, span: int) -> np.ndarray:
    """Places whose hash is the least of some window of `span` hashes."""
    if not len(grams):
        return np.empty(0, dtype=np.int64)
    span = min(span, len(grams))
    low = minima(grams, span)
    # a place is selected if the least of one of the windows over it is its own
    edge = np.zeros(span - 1, dtype=np.uint64)
    high = ~minima(~np.concatenate([edge, low, edge]), span)
    return np.flatnonzero(high == grams)


def _suffixes(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """(id, key, n_words, hs): each row's words counted, and the hashes of its selected suffixes, as often as they occur."""

    def batches(it):
        for b in it:
            n, hs = [], []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                n.append(len(words))
                if len(words) < least:
                    hs.append(np.empty(0, np.uint64))
                    continue
                g = run_hashes(word_hashes(words), gram)
                hs.append(g[selected(g, least - gram + 1)])
            flat = pa.array(np.concatenate([*hs, np.empty(0, np.uint64)]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hs])]).astype(np.int32)), flat)
            yield pa.record_batch([b.column("id"), b.column("key"), pa.array(n, pa.int64()), lists], names=["id", "key", "n_words", "hs"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "key", "text").mapInArrow(batches, f"id {kind}, key long, n_words long, hs array<long>")


def _places(text: str, wanted: list[int], least: int, gram: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's words; the places and hashes of its wanted suffixes; and the first and last of the windows of `least` words that each was selected for.

    A passage's windows select the same suffix in each of its copies, so each window
    is looked for at its own one alone.
    """
    words = words_of(text)
    g = run_hashes(word_hashes(words), gram)
    low = minima(g, least - gram + 1)
    at = selected(g, least - gram + 1)
    at = at[np.isin(g[at].view(np.int64), np.array(wanted, dtype=np.int64))]
    start = at[:, None] - np.arange(least - gram, -1, -1)[None, :]
    inside = (start >= 0) & (start < len(low))
    own = inside & (low[np.where(inside, start, 0)] == g[at][:, None])
    first, last = own.argmax(axis=1), own.shape[1] - 1 - own[:, ::-1].argmax(axis=1)
    rows = np.arange(len(at))
    return words, at, g[at].view(np.int64), start[rows, first], start[rows, last]


def _taken_along(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """Each wanted suffix of a row as (h, key, at, before, behind), with the words before and behind it that its windows have.

    For suffixes of `common` hashes instead the windows, as (key, at, v1, v2), the
    latter being the digest of the `least` words from `at` on.
    """

    def batches(it):
        for b in it:
            held: list[tuple] = []
            n = 0
            for k, t in enumerate(b.column("text").to_pylist()):
                wanted, common = (b.column(c)[k].as_py() for c in ("wanted", "common"))
                words, at, h, first, last = _places(t, wanted + common, least, gram)
                hot = np.isin(h, np.array(common, dtype=np.int64)) if common else np.zeros(len(h), dtype=bool)
                own = list(zip(at[~hot].tolist(), first[~hot].tolist(), last[~hot].tolist()))
                start = np.unique(np.concatenate([np.empty(0, np.int64), *(np.arange(a, z + 1) for a, z in zip(first[hot].tolist(), last[hot].tolist()))]))
                before, behind = [b" ".join(words[a:p]) for p, a, _ in own], [b" ".join(words[p : z + least]) for p, _, z in own]
                v = b"".join(xxhash.xxh3_128_digest(b" ".join(words[p : p + least])) for p in start.tolist())
                held.append((h[~hot], np.full(len(own) + len(start), k), np.concatenate([at[~hot], start]), before, behind, np.frombuffer(v, dtype="<i8").reshape(-1, 2)))
                n += len(own) + len(start)
                if n >= ROWS:
                    yield given(b, held)
                    held, n = [], 0
            if n:
                yield given(b, held)

    def given(b, held):
        # by text its suffixes, then its windows
        h = pa.concat_arrays([pa.concat_arrays([pa.array(x[0]), pa.nulls(len(x[5]), pa.int64())]) for x in held])
        k, at = (np.concatenate([x[j] for x in held]) for j in (1, 2))
        before, behind = (pa.array([t for x in held for t in (*x[j], *[None] * len(x[5]))], pa.binary()) for j in (3, 4))
        v = [pa.concat_arrays([y for x in held for y in (pa.nulls(len(x[3]), pa.int64()), pa.array(np.ascontiguousarray(x[5][:, j])))]) for j in (0, 1)]
        return pa.record_batch([h, b.column("key").take(pa.array(k)), pa.array(at), before, behind, *v], names=["h", "key", "at", "before", "behind", "v1", "v2"])

    return rows.mapInArrow(batches, "h long, key long, at long, before binary, behind binary, v1 long, v2 long")


def _ordered(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The rows' order by group, then by the ids of their words."""
    flat = np.ascontiguousarray(np.column_stack([group, ids]).astype(">u4"))
    return np.argsort(flat.view(f"V{4 * flat.shape[1]}").ravel(), kind="stable")


def _common(group: np.ndarray, ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By place in the order, how many words a row has in common with its neighbour before, from the first on; -1 across groups."""
    same = np.zeros((len(order), ids.shape[1] + 1), dtype=bool)
    same[1:, :-1] = ids[order[1:]] == ids[order[:-1]]
    out = same.argmin(axis=1)
    out[np.concatenate([[True], group[order[1:]] != group[order[:-1]]])] = -1
    return out


def _matrix(texts: list[bytes], number: dict[bytes, int], width: int, backwards: bool) -> np.ndarray:
    """(rows, width) of word numbers; beyond a row's words a number that no other row has."""
    out = np.broadcast_to((len(number) + np.arange(len(texts), dtype=np.uint32))[:, None], (len(texts), width)).copy()
    for row, t in zip(out, texts):
        words = [number[w] for w in t.split()]
        row[: len(words)] = words[::-1] if backwards else words
    return out


def matches(group: np.ndarray, before: list[bytes], behind: list[bytes], least: int) -> list[np.ndarray]:
    """For each number a of words before the suffix, the class of the window of `least` words that begins there, -1 where there is none.

    Two suffixes of a group have one class where the a words before them and the
    least - a words from them on are the same.
    """
    words: set[bytes] = set()
    for t in (*before, *behind):
        words.update(t.split())
    number = {w: k for k, w in enumerate(sorted(words))}
    n_left, n_right = (np.array([t.count(b" ") + 1 if t else 0 for t in x], dtype=np.int64) for x in (before, behind))
    reach = int(n_left.max(initial=0))
    left, right = _matrix(before, number, reach, True), _matrix(behind, number, int(n_right.max(initial=least)), False)
    del words, number
    by_left, by_right = _ordered(group, left), _ordered(group, right)
    common_left, common_right = _common(group, left, by_left), _common(group, right, by_right)
    out = []
    for a in range(reach + 1):
        run_left, run_right = np.empty(len(group), dtype=np.int64), np.empty(len(group), dtype=np.int64)
        run_left[by_left] = np.cumsum(common_left < a)
        run_right[by_right] = np.cumsum(common_right < least - a)
        out.append(np.where((n_left >= a) & (n_right >= least - a), run_right * (len(group) + 1) + run_left, -1))
    return out


def _compare(least: int):
    """Read suffixes sorted by hash as a stream and give, per batch, ranges and edges as FOUND."""

    def give(parts):
        h, key, at = (np.concatenate([p[k] for p in parts]) for k in range(3))
        before, behind = ([t for p in parts for t in p[k]] for k in (3, 4))
        classes = matches(np.unique(h, return_inverse=True)[1], before, behind, least)
        hit = np.zeros((2, len(h), len(classes)), dtype=bool)
        u, v = [], []
        for a, found in enumerate(classes):
            rows = np.flatnonzero(found >= 0)
            order = rows[np.lexsort((key[rows], found[rows]))]
            if len(order) < 2:
                continue
            c, k = found[order], key[order]
            cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            size = np.diff(np.append(cut, len(order)))
            low = np.repeat(k[cut], size)
            shared = low != np.repeat(k[np.append(cut[1:], len(order)) - 1], size)
            hit[0, order[shared], a] = True
            again = (c[1:] == c[:-1]) & (k[1:] == k[:-1])
            hit[1, order[1:][again], a] = hit[1, order[:-1][again], a] = True
            u.append(k[shared])
            v.append(low[shared])
        for within in (False, True):
            # runs of neighbouring offsets make one range
            padded = np.pad(hit[int(within)], ((0, 0), (1, 1))).astype(np.int8)
            i, first = np.nonzero(np.diff(padded, axis=1) == 1)
            _, last = np.nonzero(np.diff(padded, axis=1) == -1)
            if len(i):
                start, end = at[i] - (last - 1), at[i] - first + least
                yield pa.record_batch([pa.array(key[i]), pa.array(start), pa.array(end), pa.array(np.full(len(i), within)), pa.nulls(len(i), pa.int64())], names=["key", "start", "end", "within", "other"])
        if u:
            a, b = spanning_forest(np.concatenate(u), np.concatenate(v))
            none = pa.nulls(len(a), pa.int64())
            yield pa.record_batch([pa.array(a), none, none, pa.nulls(len(a), pa.bool_()), pa.array(b)], names=["key", "start", "end", "within", "other"])

    def batches(it):
        held: list[tuple] = []
        for b in it:
            if not b.num_rows:
                continue
            h = b.column("h").to_numpy()
            part = (h, b.column("key").to_numpy(), b.column("at").to_numpy(), b.column("before").to_pylist(), b.column("behind").to_pylist())
            last = int(np.argmax(h == h[-1]))  # sorted: where the last hash begins
            if last or (held and held[-1][0][-1] != h[0]):
                yield from give([*held, tuple(x[:last] for x in part)] if last else held)
                held = []
            held.append(tuple(x[last:] for x in part))
        if held:
            yield from give(held)

    return batches


def _scan_windows(least: int):
    """Read windows sorted by digest and key as a stream and give FOUND, and apart, with their digest, the first and last digest's key and open places.

    A digest's places of its least key stay open until another key comes; they are
    those of one text.  Whether one comes in another task is decided afterwards.
    """
    names = ["key", "start", "end", "within", "other", "v1", "v2", "shared"]

    def rows(key, start=None, within=None, other=None, v=None, shared=None):
        n = len(key)
        none = pa.nulls(n, pa.int64())
        start, end = (none, none) if start is None else (pa.array(start), pa.array(start + least))
        v1, v2 = (none, none) if v is None else (pa.array(np.full(n, x)) for x in v)
        flag = lambda x: pa.array([x] * n, pa.bool_())
        return pa.record_batch([pa.array(key), start, end, flag(within), none if other is None else pa.array(other), v1, v2, flag(shared)], names=names)

    def batches(it):
        held = None  # the rows of the last digest and key
        run = None  # the last digest, its least key, whether it is shared, and its open places
        begun = False

        def bound(v, low, shared, open_):
            yield rows(np.array([low]), v=v, shared=shared)
            if len(open_):
                yield rows(np.full(len(open_), low), open_, v=v, shared=shared)

        def scanned(v1, v2, key, at):
            nonlocal run, begun
            new = np.concatenate([[True], (v1[1:] != v1[:-1]) | (v2[1:] != v2[:-1])])
            goes_on = run is not None and run[0] == (v1[0], v2[0])
            cut = np.flatnonzero(new)
            size = np.diff(np.append(cut, len(key)))
            low, high = key[cut].copy(), key[np.append(cut[1:], len(key)) - 1]
            shared = low != high
            if goes_on:
                low[0] = run[1]
                shared[0] |= run[2] or high[0] != low[0]
                if shared[0] and len(run[3]):
                    yield rows(np.full(len(run[3]), run[1]), run[3], within=False)
            if run is not None and not goes_on and not begun:
                yield from bound(*run)
                begun = True
            if len(cut) > 1 and not begun:
                begun = True
                first = at[: cut[1]] if not shared[0] else at[:0]
                yield from bound((v1[0], v2[0]), low[0], bool(shared[0]), np.concatenate([run[3], first]) if goes_on and not shared[0] else first)
            each_low, each = np.repeat(low, size), np.repeat(shared, size)
            yield rows(key[each], at[each], within=False)
            linked = each & (key != each_low)
            a, b = spanning_forest(key[linked], each_low[linked])
            yield rows(a, other=b)
            same = (key[1:] == key[:-1]) & ~new[1:]
            again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            yield rows(key[again], at[again], within=True)
            open_ = at[:0] if shared[-1] else at[cut[-1] :]
            run = ((v1[-1], v2[-1]), low[-1], bool(shared[-1]), np.concatenate([run[3], open_]) if goes_on and len(cut) == 1 and not shared[-1] else open_)

        for b in it:
            if not b.num_rows:
                continue
            part = [b.column(c).to_numpy() for c in ("v1", "v2", "key", "at")]
            part = [np.concatenate(x) for x in zip(held, part)] if held else part
            last = int(np.argmax(np.logical_and.reduce([x == x[-1] for x in part[:3]])))
            if last:
                yield from scanned(*(x[:last] for x in part))
            held = [x[last:] for x in part]
        if held:
            yield from scanned(*held)
            yield from bound(*run)

    return batches


def _sorted_windows(each: DataFrame, least: int) -> DataFrame:
    """FOUND for the windows (key, at, v1, v2) of the suffixes of very common hashes: sorted over all tasks, so that a window's places may lie in several."""
    dealt = each.repartitionByRange("v1", "v2", "key").sortWithinPartitions("v1", "v2", "key")
    out = checkpointed(dealt.mapInArrow(_scan_windows(least), FOUND + ", v1 long, v2 long, shared boolean"))
    # at most two digests a task, each with the places of one text
    ends = out.where("v1 is not null").groupBy("v1", "v2").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.bool_or("shared").alias("shared"), F.collect_set(F.struct("key", "start", "end")).alias("places"))
    ends = ends.where("low != high or shared").select("low", F.explode("places").alias("x")).select("low", "x.*")
    none = F.lit(None).cast("long")
    ranges = ends.where("start is not null").select("key", "start", "end", F.lit(False).alias("within"), none.alias("other"))
    edges = ends.where("key != low").select("key", none.alias("start"), none.alias("end"), F.lit(None).cast("boolean").alias("within"), F.col("low").alias("other")).distinct()
    return out.where("v1 is null").select("key", "start", "end", "within", "other").union(ranges).union(edges)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """(id, class_id, n_words, n_repeated, n_within, spans) per row.

    spans are the word ranges (start, end exclusive), merged, that lie in passages
    of `least` words or more which another document holds too; n_repeated is the
    words in them, and n_within the words in passages that the text itself holds
    more than once.  class_id is the smallest id reachable over shared passages, the
    own id included.  Null, empty and short texts have no spans.  Documents are told
    apart by id and text: repeated rows are one document, a row without an id is one
    of its own, and several texts under one id are several.  Ids may be of any type
    that has an order; a null is a class's id only where it has no other.  An empty
    table gives an empty result.
    """
    hot = HOT if hot is None else hot
    text = F.coalesce("text", F.lit(""))
    own = own_columns(docs, id=id_col, text=text_col).select("id", F.xxhash64(text).alias("key"), text.alias("text"))
    rows = checkpointed(_suffixes(own, least, gram))
    by_text = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"), F.count("id").alias("named"), F.first("n_words").alias("n_words"), F.first("hs").alias("hs"))
    several = (F.col("low") != F.col("high")) | (F.col("n") - F.col("named") > 1) | ((F.col("n") > F.col("named")) & (F.col("named") > 0))
    by_text = checkpointed(by_text.select("key", "low", "n", "n_words", "hs", (F.coalesce(several, F.col("n") > 1) & (F.col("n_words") >= least)).alias("whole")))

    dealt = by_text.select("key", F.explode("hs").alias("h"))
    again = checkpointed(dealt.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    total = dealt.count()
    kept = joined(dealt, again, "h", F.col("n") * HEAVY > total)
    by_doc = checkpointed(kept.groupBy("key").agg(F.collect_set(F.when(F.col("n") <= hot, F.col("h"))).alias("wanted"), F.collect_set(F.when(F.col("n") > hot, F.col("h"))).alias("common")))
    # copies of a text are made one before they travel
    texts = own.groupBy("key").agg(F.first("text").alias("text"))
    along = _taken_along(texts.join(by_doc, "key"), least, gram)
    place = scratch(docs.sparkSession, "passages")
    common = not again.where(F.col("n") > hot).isEmpty()
    if common:
        # two ways of comparing read what the texts gave once
        along.write.parquet(place)
        along = docs.sparkSession.read.parquet(place)
    dealt_out = along.where("h is not null").drop("v1", "v2").repartition("h").sortWithinPartitions("h")
    found = dealt_out.mapInArrow(_compare(least), FOUND)
    if common:
        found = found.union(_sorted_windows(along.where("v1 is not null").select("key", "at", "v1", "v2"), least))
    found = checkpointed(found)
    remove(docs.sparkSession, place)

    classes = connected_components(found.where("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "key")
    grouped = by_text.join(classes, "key", "left").select("key", "low", "n", "whole", F.coalesce("component", "key").alias("group"), F.col("component").isNotNull().alias("linked"))
    grouped = checkpointed(grouped)
    lowest = grouped.groupBy("group").agg(F.min("low").alias("class_id"), F.count("*").alias("members"))
    named = joined(grouped, lowest, "group", F.col("members") * HEAVY > grouped.count())
    spans = merged_ranges(found.where("start is not null and not within"), "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    inner = merged_ranges(found.where("within"), "key").groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("n_within"))
    of_text = checkpointed(named.join(spans, "key", "left").join(inner, "key", "left").select("key", "n", "whole", "linked", "class_id", "spans", "n_within"))

    count = rows.count()
    out = joined(rows.select("id", "key", "n_words"), of_text, "key", F.col("n") * HEAVY > count)
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    out = out.withColumn("spans", F.when(F.col("whole"), all_).otherwise(F.coalesce("spans", none)))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["start"]))
    one_of = F.when(F.col("whole") | F.col("linked"), F.col("class_id")).otherwise(F.col("id"))
    return out.select("id", one_of.alias("class_id"), "n_words", size.alias("n_repeated"), F.coalesce("n_within", F.lit(0)).cast("long").alias("n_within"), "spans")
