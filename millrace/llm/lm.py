"""Language-model scores from a probabilistic suffix tree over words, with a unigram base.

The tree's symbols are the words of a text with A-Z lower-cased, and an end
symbol.  Its root is the smoothed unigram distribution.  A context - the last
word, or the last two - is retained if its next-symbol distribution diverges
from its parent's (the context without its first word) by more than chance, and
is smoothed towards the parent's: what its kept counts leave goes to the parent's
distribution.  A text is scored by the longest retained suffix at each position.

Counts are taken over all training rows, and a pair or triple of words counts from
LEAST occurrences on whatever the corpus.  The levels are tables.  What has a fixed
share of all tokens is also held as a tree in memory, which the share bounds; what
the rest adds to a score is joined from the tables by key, so that scores do not
depend on the share.  Keys are 63-bit hashes.  A filter of the joined keys spares
lines that would meet nothing; it admits too much where it is full, never too little.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_fold, own_columns, remove, scratch, written

#: Least share of all tokens of what the tree in memory holds: words, and contexts with a next word.
WORD_SHARE, PAIR_SHARE = 1e-6, 5e-7
#: Least count of a context with a next word.
LEAST = 3
#: Share of all tokens from which on a key meets a broadcast list, which holds fewer than its inverse.
HOT_SHARE = 1e-4
#: Bits of the filter for each key, and at most.
FILTER_BITS, FILTER_MOST = 32, 1 << 27
FILTER_BLOCK = 1 << 16
#: Divergence times count, in nats, that a context must exceed, over the log of the tokens.
DIVERGENCE = 3.0
#: Weight of the parent's distribution, in symbols.
PRIOR = 4.0
#: Bits of a word's number; the shares keep it and the number of pairs below.
BITS = 21
CHUNK = 1_000_000
HELD_WORDS = 250_000
HELD_PAIRS = 600_000
#: Settings of the writes that read texts in Python: smaller batches.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Parts in which rows are scored, one after the other; more need less disk at a time and read the counts more often.
SLICES = 2
#: What a row's own line says of it.
OWN = ["id", "tokens", "known", "base", "score"]

#: The end token, and what stands before a text; a word never holds a blank.
END_WORD = b" "
START_WORD = b"  "


def words(text: bytes) -> list[bytes]:
    """The words of a text whose A-Z are lower-cased already."""
    return text.split()


def _lowered(column: pa.Array) -> list[bytes]:
    return [(t or b"").lower() for t in column.cast(pa.binary()).to_pylist()]


def _sliced(batches, rows: int = 500):
    """Small slices of the batches, so that few texts are held as Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _chunks(texts: list[bytes], size: int):
    chunk: list[bytes] = []
    held = 0
    for t in texts:
        if chunk and held + len(t) > size:
            yield chunk
            chunk, held = [], 0
        chunk.append(t)
        held += len(t)
    if chunk:
        yield chunk


def count_words(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n long): how often each word and the end occur, added up per task."""

    def batches(it):
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in _sliced(it):
            for chunk in _chunks(_lowered(b.column("text")), CHUNK):
                flat = [w for t in chunk for w in words(t)]
                flat += [END_WORD] * len(chunk)
                seen = pa.array(flat, pa.binary()).value_counts()
                held.append(pa.table({"word": seen.field("values"), "n": seen.field("counts")}))
                if sum(x.num_rows for x in held) > HELD_WORDS:
                    held[:] = [merged()]
                    if held[0].num_rows > HELD_WORDS // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    return own_columns(train, text=text_col).mapInArrow(batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one length with their kept next words: codes (context number and next word), counts, and by context its count, rest and whether it is retained."""

    code: np.ndarray
    n: np.ndarray
    size: np.ndarray
    rest: np.ndarray
    retained: np.ndarray

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the kept (context, word) pairs, -1 where there is none."""
        if not len(self.code):
            return np.full(len(context), -1)
        wanted = (context.astype(np.int64) << BITS) | word
        at = np.searchsorted(self.code, wanted)
        at[at == len(self.code)] = 0
        return np.where((self.code[at] == wanted) & (context >= 0) & (word >= 0), at, -1)


@dataclass
class Tree:
    """Numbers of the common words, their root probabilities, and the levels below the root."""

    words: list[bytes]
    root: np.ndarray
    levels: list[Level]
    _number: dict[bytes, int] | None = None

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[bytes]]]:
        """The numbers of START, words and END of each text on end (-1: not common), and the texts' tokens."""
        if self._number is None:
            self._number = {w: k for k, w in enumerate(self.words)}
        get = self._number.get
        tokens = [[*words(t), END_WORD] for t in texts]
        start = get(START_WORD, -1)
        flat: list[int] = []
        for t in tokens:
            flat.append(start)
            flat.extend(get(w, -1) for w in t)
        return np.array(flat, dtype=np.int64), tokens

    def contexts(self, flat: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """By level, the context number before each token, -1 where it has none; first marks the starts."""
        out = [np.concatenate([[-1], flat[:-1]])]
        for level in self.levels[:1]:
            pair = level.find(out[0], flat)
            pair[first] = -1
            out.append(np.concatenate([[-1], pair[:-1]]))
        for c in out:
            c[first] = -1
        return out

    def scored(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """log10(), and by level whether the tree says all that the run which ends at a token adds, so that no table need be asked."""
        p, whole = np.where(flat >= 0, self.root[flat], 1.0), []
        for k, (level, context) in enumerate(zip(self.levels, self.contexts(flat, first))):
            known = context >= 0
            own = known.copy()
            own[own] = level.retained[context[own]]
            at = np.flatnonzero(own)
            c = context[at]
            found = level.find(c, flat[at])
            n = np.where(found >= 0, level.n[found], 0.0) if len(level.n) else np.zeros(len(at))
            p[at] = (n + level.rest[c] * p[at]) / (level.size[c] + PRIOR)
            # runs of the last level are no contexts, so that one after a context that isn't retained adds nothing
            settled = known & ~own if k + 1 == len(self.levels) else np.zeros(len(flat), dtype=bool)
            settled[at[found >= 0]] = True
            whole.append(settled)
        p[first] = 1.0
        return np.log10(p), whole

    def log10(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token; of a word that isn't common, the part that comes on top of its root probability; 0 at starts."""
        return self.scored(flat, first)[0]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_number": None}


def _starts(tokens: list[list[bytes]]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) + 1 for t in tokens])[:-1]]).astype(np.int64)


def _hashes(tokens) -> np.ndarray:
    """Odd 64-bit hashes of words."""
    flat = np.empty(len(tokens), dtype=object)
    flat[:] = tokens
    return pd.util.hash_array(flat, categorize=False) | np.uint64(1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Odd 64-bit keys of two keys in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x | np.uint64(1)


def _keys(tokens: list[list[bytes]], first: np.ndarray) -> list[np.ndarray]:
    """By length from 1 to 3, the key of the words that end at each place of START, words and END; 0 where a text has none."""
    h = _hashes([w for t in tokens for w in (START_WORD, *t)])
    pair = np.zeros(len(h), dtype=np.uint64)
    pair[1:] = _pair(h[:-1], h[1:])
    pair[first] = 0
    triple = np.zeros(len(h), dtype=np.uint64)
    triple[1:] = np.where((pair[:-1] != 0) & (pair[1:] != 0), _pair(pair[:-1], h[1:]), np.uint64(0))
    return [h, pair, triple]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


@dataclass
class Filter:
    """A bit by key; every key that was put in is found."""

    bits: np.ndarray

    def has(self, key: np.ndarray) -> np.ndarray:
        at = (key >> np.uint64(1)) & np.uint64(len(self.bits) * 8 - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (key != 0)


def _filter(keys: DataFrame) -> Filter:
    """The filter of the column key."""
    wanted = FILTER_BITS * keys.count()
    size = min(FILTER_MOST, max(FILTER_BLOCK, 1 << wanted.bit_length()))
    at = F.shiftrightunsigned("key", 1).bitwiseAND(F.lit(size - 1))

    def block(rows: pa.Table) -> pa.Table:
        bits = np.zeros(FILTER_BLOCK, dtype=np.uint8)
        bits[rows.column("at").to_numpy() % FILTER_BLOCK] = 1
        return pa.table({"block": rows.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    got = keys.select(at.alias("at")).select("at", F.floor(F.col("at") / FILTER_BLOCK).cast("long").alias("block")).groupBy("block").applyInArrow(block, "block long, bits binary").toArrow()
    out = np.zeros((size // FILTER_BLOCK, FILTER_BLOCK // 8), dtype=np.uint8)
    for k, bits in zip(*(c.to_pylist() for c in got.columns)):
        out[k] = np.frombuffer(bits, dtype=np.uint8)
    return Filter(out.ravel())


def count_runs(train: DataFrame, length: int, kept: Filter | None = None, text_col: str = "text") -> DataFrame:
    """(a, b, [c,] n, key, [head, tail]): pairs or triples of words that occur LEAST times or more, by the hashes of their words.

    kept holds the shorter runs that one must consist of to occur so often: words
    of a pair, pairs of a triple.  head and tail are the keys of a triple's pairs.
    """
    names = ["a", "b", "c"][:length]

    def batches(it):
        held: list[list[np.ndarray]] = []

        def merged():
            key, where, back = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([x[1] for x in held]), minlength=len(key)).astype(np.int64)
            return [key, n, *(np.concatenate([x[k + 2] for x in held])[where] for k in range(length))]

        def rows(x):
            return pa.record_batch([*(_signed(c) for c in x[2:]), pa.array(x[1])], names=[*names, "n"])

        for b in _sliced(it):
            for chunk in _chunks(_lowered(b.column("text")), CHUNK):
                tokens = [[*words(t), END_WORD] for t in chunk]
                keys = _keys(tokens, _starts(tokens))
                ok = keys[length - 1] != 0
                if kept is not None:
                    has = kept.has(keys[length - 2])
                    ok[1:] &= has[:-1] & has[1:]
                at = np.flatnonzero(ok)
                key, where, n = np.unique(keys[length - 1][at], return_index=True, return_counts=True)
                at = at[where]
                held.append([key, n, *(keys[0][at - length + 1 + k] for k in range(length))])
                if sum(len(x[0]) for x in held) > HELD_PAIRS:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield rows(held.pop())
        if held:
            yield rows(merged())

    def keyed(it):
        for b in it:
            w = [_unsigned(b.column(c)) for c in names]
            pairs = [_pair(x, y) for x, y in zip(w, w[1:])]
            key = pairs if length == 2 else [_pair(pairs[0], w[2]), *pairs]
            yield pa.record_batch([*b.columns, *(_signed(x) for x in key)], names=[*names, "n", "key", "head", "tail"][: length + 1 + len(key)])

    kind = "".join(f"{c} long, " for c in names) + "n long"
    counted = own_columns(train, text=text_col).mapInArrow(batches, kind).groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return counted.mapInArrow(keyed, kind + ", key long" + (", head long, tail long" if length == 3 else ""))


def _joined(rows: DataFrame, right: DataFrame, key: str, hot: Column) -> DataFrame:
    """rows with right's columns by key, which right has once each; its hot keys meet a broadcast list."""
    listed = F.broadcast(right.where(hot))
    return rows.join(listed, key).unionByName(rows.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(right.where(~hot), key))


def _contexts(rows: DataFrame, sizes: DataFrame, key: str, tokens: int) -> DataFrame:
    """(key, size, rest, retained) of the contexts of rows (key, n, parent): parent is the parent's probability of the next word."""
    sums = rows.groupBy(key).agg(F.sum("n").alias("kept"), F.sum("parent").alias("expected"), F.sum(F.col("n") * F.log(F.col("n") / F.col("parent"))).alias("gain"))
    left = F.col("size") - F.col("kept")
    other = F.when(left > 0, left * F.log(left / F.col("size") / F.greatest(1 - F.col("expected"), F.lit(1e-12)))).otherwise(0.0)
    gain = F.col("gain") - F.col("kept") * F.log("size") + other
    retained = gain > DIVERGENCE * math.log(max(tokens, 2))
    return sums.join(sizes, key).select(key, "size", (left + PRIOR).alias("rest"), retained.alias("retained"))


@dataclass
class Model:
    """What scoring needs: the packed tree, token totals, the table of all words' counts, and what keys outside of the tree add."""

    packed: bytes
    tokens: int
    vocabulary: int
    least: int
    table: DataFrame
    added: DataFrame
    filter: Filter


def fit(docs: DataFrame, usable: Column | None = None, text_col: str = "text") -> Model:
    """A model of all usable rows.  No usable row: no word is known and every token has the same probability."""
    spark = docs.sparkSession
    train = docs.where(usable) if usable is not None else docs
    place = scratch(spark, "lm")

    def stored(name: str, df: DataFrame) -> DataFrame:
        return written(df, f"{place}/{name}", BATCHES)

    def done(*names: str) -> None:
        for name in names:
            remove(spark, f"{place}/{name}")

    def hashed(it):
        for b in it:
            yield pa.record_batch([*b.columns, _signed(_hashes(b.column("word").to_pylist()))], names=["word", "n", "key"])

    table = stored("words", count_words(train, text_col).mapInArrow(hashed, "word binary, n long, key long"))
    whole = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least, enough, hot = (max(m, math.ceil(whole.n * share)) for m, share in ((1, WORD_SHARE), (LEAST, PAIR_SHARE), (1, HOT_SHARE)))
    common = {bytes(w): n for w, n in zip(*(c.to_pylist() for c in table.where(F.col("n") >= least).select("word", "n").toArrow().columns))}
    names = sorted(common)
    n = np.array([common[w] for w in names], dtype=float)
    floor = whole.n + 0.5 * (whole.v + 1)
    texts = table.where(F.col("word") == F.lit(END_WORD)).select("n").first()
    texts = texts.n if texts else 0

    # a word is a context as often as it occurs, but for the end; a text's start as often as there are texts
    start = int(_hashes([START_WORD]).view(np.int64)[0])
    sizes = table.where(F.col("word") != F.lit(END_WORD)).select(F.col("key").alias("a"), F.col("n").alias("size"))
    sizes = sizes.union(spark.range(1).select(F.lit(start).alias("a"), F.lit(texts).cast("long").alias("size")))
    share = (F.col("n") + F.col("rest") * F.col("parent")) / (F.col("size") + PRIOR)
    back = F.log10(F.col("rest") / (F.col("size") + PRIOR))
    own = F.when(F.col("retained"), share).otherwise(F.col("parent"))
    over = F.when(F.col("retained"), F.log10(share / F.col("parent")) - back).otherwise(0.0)

    # a run occurs often enough only if the shorter ones in it do; a text's start isn't counted as a word
    often = table.where(F.col("n") >= LEAST).select("key").union(spark.range(1).select(F.lit(start).alias("key")))
    counted = stored("counted2", count_runs(train, 2, _filter(often), text_col))
    roots = table.select(F.col("key").alias("b"), ((F.col("n") + 0.5) / F.lit(floor)).alias("parent"), F.col("n").alias("m"))
    rooted = stored("rooted", _joined(counted, roots, "b", F.col("m") >= hot).drop("m"))
    one = stored("contexts1", _contexts(rooted, sizes, "a", whole.n))
    pairs = stored("pairs", _joined(rooted, one, "a", F.col("size") >= hot).select("a", "b", "n", "key", own.alias("p"), over.alias("over")))
    done("counted2", "rooted")

    counted = stored("counted3", count_runs(train, 3, _filter(pairs), text_col))
    below = pairs.select(F.col("key").alias("tail"), F.col("p").alias("parent"), F.col("n").alias("m"))
    rooted = stored("rooted3", _joined(counted, below, "tail", F.col("m") >= hot).select("head", "c", "n", "key", "parent"))
    two = stored("contexts2", _contexts(rooted, pairs.select(F.col("key").alias("head"), F.col("n").alias("size")), "head", whole.n))
    triples = stored("triples", _joined(rooted, two, "head", F.col("size") >= hot).select("head", "c", "n", "key", over.alias("over")))
    done("counted3", "rooted3")

    kept = F.col("retained")
    rare = table.where(F.col("n") < least).join(one.where(kept).select(F.col("a").alias("key"), back.alias("back")), "key", "left")
    apart = pairs.where(F.col("n") < enough).join(two.where(kept).select(F.col("head").alias("key"), back.alias("back")), "key", "left")
    lone = apart.select("key", (F.col("over") + F.coalesce("back", F.lit(0.0))).alias("value")).union(triples.where(F.col("n") < enough).select("key", F.col("over").alias("value")))
    lone = stored("added", lone.where("value != 0"))
    added = rare.select("key", "n", F.coalesce("back", F.lit(0.0)).alias("value")).union(lone.select("key", F.lit(None).cast("long"), "value"))

    tree = Tree([*names, START_WORD], np.append((n + 0.5) / floor, 1.0), [])
    by_hash = _hashes(tree.words)
    order = np.argsort(by_hash)

    def number(column) -> np.ndarray:
        return order[np.searchsorted(by_hash, _unsigned(column), sorter=order)]

    def level(code, m, size, at, contexts) -> Level:
        rest, retained = size + PRIOR, np.zeros(len(size), dtype=bool)
        rest[at], retained[at] = (contexts.column(c).to_numpy() for c in ("rest", "retained"))
        by = np.argsort(code)
        return Level(code[by], m[by].astype(float), size, rest, retained)

    held = one.join(F.broadcast(spark.createDataFrame([(x,) for x in by_hash.view(np.int64).tolist()], "a long")), "a").select("a", "rest", "retained").toArrow()
    near = pairs.where(F.col("n") >= enough).select("a", "b", "n", "key").toArrow()
    size = np.append(np.where(np.array([w == END_WORD for w in names], dtype=bool), 0, n), texts).astype(float) if names else np.array([float(texts)])
    code = (number(near.column("a")) << BITS) | number(near.column("b"))
    m = near.column("n").to_numpy()
    tree.levels.append(level(code, m, size, number(held.column("a")), held))

    by = np.argsort(code)
    key = _unsigned(near.column("key"))[by]
    by_key = np.argsort(key)

    def place_of(column) -> np.ndarray:
        return by_key[np.searchsorted(key, _unsigned(column), sorter=by_key)]

    held = two.where(F.col("size") >= enough).select("head", "rest", "retained").toArrow()
    far = triples.where(F.col("n") >= enough).select("head", "c", "n").toArrow()
    code = (place_of(far.column("head")) << BITS) | number(far.column("c"))
    tree.levels.append(level(code, far.column("n").to_numpy(), tree.levels[0].n.copy(), place_of(held.column("head")), held))
    done("pairs", "triples", "contexts2")
    return Model(pickle.dumps(tree), whole.n, whole.v, least, table, added, _filter(lone))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) per row, as tables that are written here.

    A null text is empty and has the end token alone.  Repeated rows give a row
    each, null ids are kept, an empty table gives an empty result.
    """
    tree, joined = pickle.loads(model.packed), model.filter
    floor = model.tokens + 0.5 * (model.vocabulary + 1)

    def batches(it):
        base_log = np.log10(tree.root)
        for b in _sliced(it):
            texts, done = _lowered(b.column("text")), 0
            for chunk in _chunks(texts, CHUNK):
                flat, tokens = tree.numbers(chunk)
                first = _starts(tokens)
                common = flat >= 0
                base = np.where(common, base_log[flat], 0.0)
                base[first] = 0.0
                value, whole = tree.scored(flat, first)
                common[first] = False
                sums = [np.add.reduceat(x, first) for x in (base, value, common.astype(np.int64))]
                missing = ~common
                missing[first] = False
                key, pair, triple = _keys(tokens, first)
                places = [np.flatnonzero(missing), *(np.flatnonzero(joined.has(x) & ~said) for x, said in zip((pair, triple), whole))]
                wanted = np.concatenate([x[p] for x, p in zip((key, pair, triple), places)])
                owner = np.searchsorted(first, np.concatenate(places), side="right") - 1
                _, at, times = np.unique(_pair(wanted, owner.astype(np.uint64)), return_index=True, return_counts=True)
                m, k = len(chunk), len(at)
                rows, ids = b.column("row").slice(done, m), b.column("id").slice(done, m)
                done += m
                index = pa.array(np.concatenate([np.arange(m), owner[at]]), pa.int64())
                # a row's own line has an even key, which no word has, and spreads the lines evenly
                line = rows.to_numpy().view(np.uint64) << np.uint64(1)
                own = pa.StructArray.from_arrays([ids, pa.array([len(t) for t in tokens], pa.int64()), *(pa.array(sums[k]) for k in (2, 0, 1))], names=OWN)
                yield pa.record_batch(
                    [
                        rows.take(index),
                        _signed(np.concatenate([line, wanted[at]])),
                        pa.array(np.concatenate([np.zeros(m, dtype=np.int64), times])),
                        pa.array(np.concatenate([np.zeros(m, dtype=bool), at < len(places[0])])),
                        pa.concat_arrays([own, pa.nulls(k, own.type)]),
                    ],
                    names=["row", "key", "times", "word", "own"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    kinds = f"row long, key long, times long, word boolean, own struct<id: {kind}, tokens: long, known: long, base: double, score: double>"
    rows = own_columns(docs, id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    n = F.coalesce(F.col("n"), F.lit(0))
    root = F.when(F.col("word"), F.col("times") * F.log10((n + 0.5) / F.lit(floor))).otherwise(0.0)

    def scores(part: DataFrame) -> DataFrame:
        known = part.mapInArrow(batches, kinds).join(model.added, "key", "left").select(
            "row",
            "own",
            F.coalesce("own.known", F.when(n > 0, F.col("times")).otherwise(0)).alias("known"),
            F.coalesce("own.base", root).alias("base"),
            F.coalesce("own.score", root + F.col("times") * F.coalesce("value", F.lit(0.0))).alias("score"),
        )
        summed = known.groupBy("row").agg(F.max("own.id").alias("id"), F.max("own.tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
        return summed.select("id", "n_tokens", "n_known", "base_score", "score")

    # every row is in one slice, by what it says, however it is read; the lines of a slice are dropped before the next one's are made
    place = scratch(docs.sparkSession, "lm-scores")
    out = [written(scores(rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(SLICES)) == k)), f"{place}/{k}", BATCHES) for k in range(SLICES)]
    return reduce(DataFrame.unionByName, out)


def learnable(id_col: str = "doc_id") -> Column:
    """The rows that training may use: crc32 of the id modulo 5 is not 1."""
    return id_fold(id_col, 5) != 1
