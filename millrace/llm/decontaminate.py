"""Benchmark decontamination by a prefix-filtered set join, with Spark expressions only.

A benchmark item's windows are sets of word shingles.  A document holds a window
only if it holds all the window's shingles, so the necessary prefix under
containment 1 is a single shingle: the window's rarest one, in the order of the
shingles' counts over all documents.  Only these anchors are joined.  A joined
place must leave room for the window before and behind it (length and position),
and is then verified word by word: the run of equal words around the anchor is
measured in both directions and must be as long as the window.

The texts are split and hashed once.  A bit table of the benchmark's shingles is
asked inside the array of a document's shingles, so that only few places are kept,
and the words of the documents that have one.  From these the shingles are counted,
the anchors chosen, and the anchors' places taken with the words around them; the
join and the verification that follow are exact.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, merged_ranges, own_columns, without

WINDOW = 13
SHINGLE = 5
#: Longs in a bit table, which grows with the benchmark; beyond the most a fuller table lets more places through and loses none.
LEAST_LONGS, MOST_LONGS = 1 << 12, 1 << 21
#: Parts that the places of one anchor are dealt to.
SALTS = 16

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _GAP), "")


def _shingles(ws: str, k: int) -> Column:
    """The hashes of all runs of k words of the array column, by place."""
    last = F.size(ws) - k
    at = lambda i: [F.get(F.col(ws), i + j) for j in range(k)]
    none = F.expr("cast(array() as array<bigint>)")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(k), *at(i)))).otherwise(none)


def _bit_table(hashes: DataFrame) -> list[int]:
    """Longs with two bits set for each value of the column h; 64 bits a value, up to MOST_LONGS."""
    size = LEAST_LONGS
    n = hashes.select("h").distinct().count()
    while size < min(n, MOST_LONGS):
        size *= 2
    both = hashes.select(F.explode(F.array("h", F.shiftrightunsigned("h", 32))).alias("x"))
    slot = F.expr(f"cast(shiftright(x, 6) & {size - 1} as int)").alias("slot")
    bit = F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit")
    table = [0] * size
    for r in both.select(slot, bit).groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect():  # at most MOST_LONGS rows
        table[r.slot] = r.bits
    return table


def _asks(table: list[int], h: str) -> str:
    """SQL that is true if the table may hold the hash."""
    packed = "cast(split('" + ",".join(map(str, table)) + "', ',') as array<bigint>)"
    ask = lambda x: f"(shiftright(get({packed}, cast(shiftright({x}, 6) & {len(table) - 1} as int)), cast({x} & 63 as int)) & 1) = 1"
    return f"({ask(h)} and {ask(f'shiftrightunsigned({h}, 32)')})"


def _items(benchmark: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Distinct items with words: item, key, ws, size of their windows and of their shingles."""
    rows = own_columns(benchmark, item=item_col, text=text_col).select("item", words(F.col("text")).alias("ws")).where("size(ws) > 0").distinct()
    return rows.select(
        "item", F.xxhash64("item", "ws").alias("key"), "ws", F.least(F.size("ws"), F.lit(window)).alias("win"), F.least(F.size("ws"), F.lit(shingle)).alias("k")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """(id, n_words, spans, n_hit, items) for every row of docs.

    spans are the word ranges (start, end exclusive) under occurring windows,
    merged; n_hit is the words in them; items are the ids of the items with an
    occurring window, sorted as strings.  An item of fewer than `window` words is
    one window.  Null and empty texts have no words and no hits; an item without
    words is never found and one without an id counts for its words alone;
    repeated rows give a row each; an empty benchmark gives no hits.
    """
    items = checkpointed(_items(benchmark, item_col, item_text_col, window, shingle))
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # at most `shingle` values
    parts = [items.where(F.col("k") == k).select("key", "k", F.posexplode(_shingles("ws", k)).alias("pos", "h")) for k in sizes]
    rows = own_columns(docs, id=id_col, text=text_col).select("id", words(F.col("text")).alias("ws"))
    if not parts:
        empty = F.expr("cast(array() as array<struct<start: int, end: int>>)"), F.expr("cast(array() as array<string>)")
        return rows.select("id", F.size("ws").cast("long").alias("n_words"), empty[0].alias("spans"), F.lit(0).cast("long").alias("n_hit"), empty[1].alias("items"))
    grams = parts[0]
    for p in parts[1:]:
        grams = grams.union(p)
    grams = checkpointed(grams)

    # all places of the benchmark's shingles, and the words of the documents that have any
    hashed = rows.select("*", *[_shingles("ws", k).alias(f"h{k}") for k in sizes])
    asked = _asks(_bit_table(grams), "get(h{k}, p)")
    places = F.concat(
        *[F.expr(f"transform(filter(sequence(0, size(h{k})), p -> p < size(h{k}) and {asked.replace('{k}', str(k))}), p -> struct(p as p, get(h{k}, p) as h, {k} as k))") for k in sizes]
    )
    marked = hashed.select("id", F.monotonically_increasing_id().alias("row"), F.size("ws").alias("n"), "ws", places.alias("places"))
    found = checkpointed(marked.select("id", "row", "n", "places", F.when(F.size("places") > 0, F.col("ws")).alias("ws")))

    # rarity: the benchmark's shingles counted over all documents
    counts = found.select(F.explode("places.h").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    ranked = grams.join(counts, "h", "left").select("key", "k", "pos", "h", F.coalesce("c", F.lit(0)).alias("c"))

    # the rarest shingle of each window, once for each place of an item
    by_item = ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "c", "h"))).alias("g"))
    full = items.join(by_item, "key")
    rarest = F.expr("array_distinct(transform(sequence(1, size(ws) - win + 1), o -> array_min(transform(slice(g, o, win - k + 1), x -> struct(x.c, x.h, x.pos)))))")
    reach = window - 1
    anchors = checkpointed(
        full.select("item", "ws", "win", "k", F.explode(rarest).alias("a")).select(
            "item",
            "win",
            "k",
            F.col("a.h").alias("h"),
            F.expr(f"least(a.pos, {reach})").alias("q"),
            F.expr(f"slice(ws, greatest(a.pos - {reach}, 0) + 1, least(a.pos, {reach}) + k + {reach})").alias("around"),
        )
    )

    # the anchors' places, each with the words around it
    asked = _asks(_bit_table(anchors), "x.h")
    around = f"slice(ws, greatest(x.p - {reach}, 0) + 1, least(x.p, {reach}) + x.k + {reach})"
    taken = F.expr(f"transform(filter(places, x -> {asked}), x -> struct(x.p as p, x.h as h, least(x.p, {reach}) as left, {around} as words))")
    near = found.where("size(places) > 0").select("row", F.explode(taken).alias("x")).select("row", "x.*", F.expr(f"cast(pmod(row, {SALTS}) as int)").alias("salt"))
    near = near.join(anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "salt"]).where("size(words) >= win and size(around) >= win")
    near = near.where("slice(words, left + 1, k) = slice(around, q + 1, k)")
    back = "least(left, q, win - k)"
    ahead = "least(size(words) - left - k, size(around) - q - k, win - k)"
    near = near.withColumn("l", F.expr(f"if({back} = 0, 0, size(filter(sequence(1, greatest({back}, 1)), t -> slice(words, left - t + 1, t) = slice(around, q - t + 1, t))))"))
    near = near.withColumn(
        "r", F.expr(f"if({ahead} = 0, 0, size(filter(sequence(1, greatest({ahead}, 1)), t -> slice(words, left + k + 1, t) = slice(around, q + k + 1, t))))")
    )
    hits = checkpointed(near.where("l + k + r >= win").select("row", "item", F.expr("p - l").alias("start"), F.expr("p + k + r").alias("end")))
    per_row = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    spans_of = merged_ranges(hits, "row").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    per_row = per_row.join(spans_of, "row")
    out = found.select("row", "id", "n").join(per_row, "row", "left")
    spans = F.coalesce("spans", none)
    return out.select(
        "id",
        F.col("n").cast("long").alias("n_words"),
        spans.alias("spans"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["start"])).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """The contract's rule: some word is hit, and a twentieth of all words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the contaminated rows.

    A row is judged by its own text, so ids may be null or repeated.
    """
    address = F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)
    texts = docs.select(address.alias("address"), docs[text_col].alias("text"))
    bad = contamination(texts, benchmark, "address", "text").where(contaminated()).select(F.col("id").alias("__text")).distinct()
    return without(docs.withColumn("__text", address), bad, "__text").select(*docs.columns)
