"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a labelled reference text.  A text is
parsed greedily against each automaton: a phrase is the longest match that the
reference has at that point, so the automaton's walk gives the match lengths.
A language's cost is its phrases times log2 of its reference length over the
symbols parsed - bits a symbol - and the language of least cost wins.

Texts are reduced to symbols first: letters in lower case, and one space for
each run of anything else.  The walk goes over many texts in lockstep, one
numpy step per position.  A long text is cut into segments for that: each is
walked from the root, and again from where the one before ended until both walks
are in one state, which they soon are; what the second counts more or less is
added.  So the phrases are those of one greedy parse of the whole text.

The automata's transitions are stored as one comb: a state's row is laid over the
others' gaps, and a cell says whose it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LISTED_ROWS, checkpointed, id_fold, own_columns

#: Bounds of the labelled sample: documents a language, symbols a language and symbols in all.
SAMPLE_DOCS = 48
SAMPLE_SYMBOLS = 24_000
SAMPLE_TOTAL = 1_200_000
#: Symbols that are walked in one lane.
SEGMENT = 512
#: Characters that are reduced and parsed at once, and texts that are held as Python objects at a time.
CHUNK = 1_000_000
SLICE = 500
#: Places that are tried for a row of the comb before it goes to the end.
TRIES = 64

UNDETERMINED = "und"
_SPACE, _OTHER = 0, 1
_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("explained", pa.bool_())])


def _automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton by state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class _Comb:
    """Rows of (symbol, goal) laid over each other's gaps."""

    def __init__(self, width: int):
        self.width = width
        self.used = bytearray(width)
        self.base: list[int] = []
        self.cells: list[tuple[int, int, int]] = []
        self.free = width

    def add(self, row: dict[int, int], first: int) -> None:
        """The next state's row; goals count from `first`."""
        state = len(self.base)
        at = sorted(row)
        place = self._place(at) if at else 0
        self.base.append(place)
        for c in at:
            self.used[place + c] = 1
            self.cells.append((place + c, state, first + row[c]))

    def _place(self, at: list[int]) -> int:
        need = at[-1] - at[0] + 2
        while self.free < len(self.used) and self.used[self.free]:
            self.free += 1
        p = self.free
        for _ in range(TRIES):
            if p + need > len(self.used):
                break
            if not any(self.used[p + c - at[0]] for c in at):
                return p - at[0]
            p += 1
        else:
            p = len(self.used)
        self.used.extend(bytes(max(0, p + need - len(self.used))))
        while any(self.used[p + c - at[0]] for c in at):
            p += 1
            self.used.extend(bytes(max(0, p + need - len(self.used))))
        return p - at[0]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """By state its place, and the cells: the state in the upper half, its goal in the lower; no state is -1."""
        out = np.full(len(self.used) + self.width, -1, dtype=np.int64)
        if self.cells:
            place, state, goal = np.array(self.cells, dtype=np.int64).T
            out[place] = (state << 32) | goal
        return np.array(self.base, dtype=np.int32), out


@lru_cache(maxsize=1)
def _all_letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@dataclass
class CrossParser:
    """Fitted references: languages in order, their letters, and the transitions of all their automata."""

    languages: list[str]
    letters: str
    log_lengths: np.ndarray
    roots: np.ndarray
    base: np.ndarray
    cells: np.ndarray
    first: np.ndarray
    _symbols: np.ndarray | None = None

    @classmethod
    def fit(cls, texts: dict[str, list[str]]) -> CrossParser:
        """From labelled texts by language; languages without any letter in their texts are left out.

        A language's distinct texts give equal shares of its symbols, but for short
        ones, whose room the others fill.
        """
        cap = min(SAMPLE_SYMBOLS, SAMPLE_TOTAL // max(1, len(texts)))
        seen = Counter(c for rows in texts.values() for t in rows for c in t.lower() if c.isalpha())
        letters = "".join(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])))
        none = np.empty(0, np.int64)
        self = cls([], letters, np.empty(0), none, none, none, none)
        comb, width = _Comb(len(letters) + 2), len(letters) + 2
        logs, roots, first = [], [], []
        for lang in sorted(texts):
            parts = sorted((self.reduce([t])[0] for t in sorted(set(texts[lang]))), key=len)
            room, kept = cap, []
            for k, x in enumerate(parts):
                kept.append(x[: room // (len(parts) - k)])
                room -= len(kept[-1])
            symbols = np.concatenate(kept) if kept else none
            if not (symbols != _SPACE).any():
                continue
            step, root = _automaton(symbols), len(comb.base)
            # the root has no row: whatever is not found starts a phrase, from the root's own transitions
            start = np.full(width, root, dtype=np.int64)
            start[list(step[0])] = [root + goal for goal in step[0].values()]
            for k, row in enumerate(step):
                comb.add(row if k else {}, root)
            self.languages.append(lang)
            logs.append(np.log2(len(symbols) + 1))
            roots.append(root)
            first.append(start)
        self.log_lengths, self.roots = np.array(logs), np.array(roots, dtype=np.int32)
        self.base, self.cells = comb.arrays()
        self.first = np.concatenate(first).astype(np.int32) if first else none
        return self

    def reduce(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' symbols one after another, and how many each has."""
        if self._symbols is None:
            table = _all_letters().astype(np.int32) * np.int32(_OTHER)
            for k, c in enumerate(self.letters):
                for form in {c, c.upper()}:
                    if len(form) == 1:
                        table[ord(form)] = k + 2
            self._symbols = table
        flat = self._symbols[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)]
        keep = flat != _SPACE
        keep[1:] |= flat[:-1] != _SPACE
        ends = np.cumsum([len(t) + 1 for t in texts])
        kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
        return flat[keep], np.diff(kept)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_symbols": None}

    def _step(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins; lang is the start of a language's row of `first`."""
        cell = self.cells.take(self.base.take(state) + symbol)
        begins = (cell >> 32) != state
        return np.where(begins, self.first.take(lang + symbol), cell.astype(np.int32)), begins

    def phrases(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases by language and text."""
        symbols = symbols.astype(np.int32)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(lengths) - lengths)[owner] + within * SEGMENT
        size = np.minimum(SEGMENT, lengths[owner] - within * SEGMENT)
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(1, SEGMENT + 1), side="right")  # segments with a symbol at each step
        rows = (np.arange(len(self.languages), dtype=np.int32) * (len(self.letters) + 2))[:, None]
        count = np.zeros((len(self.languages), len(owner)), dtype=np.int64)
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        by_size = start[order]
        for t in range(int(size.max()) if len(size) else 0):
            k = live[t]
            state[:, :k], begins = self._step(state[:, :k], symbols[by_size[:k] + t], rows)
            count[:, :k] += begins
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        plain, count = state[:, back], count[:, back]
        # walks that go on where the segment before ended; one that ends elsewhere than before is followed by another
        end, extra = plain.copy(), np.zeros_like(count)
        lang, seg = np.nonzero(np.broadcast_to(within > 0, count.shape))
        while len(seg):
            own, fresh = end[lang, seg - 1], self.roots[lang]
            extra[lang, seg] = 0
            open_ = np.flatnonzero(own != fresh)
            last = plain[lang, seg]
            for t in range(SEGMENT):
                if not len(open_):
                    break
                symbol, row = symbols[start[seg[open_]] + t], rows[lang[open_], 0]
                (a, more), (b, fewer) = self._step(own[open_], symbol, row), self._step(fresh[open_], symbol, row)
                own[open_], fresh[open_] = a, b
                extra[lang[open_], seg[open_]] += more.astype(np.int64) - fewer
                apart = a != b
                ended = apart & (t + 1 == size[seg[open_]])
                last[open_[ended]] = a[ended]
                open_ = open_[apart & ~ended]
            moved = last != end[lang, seg]
            end[lang[moved], seg[moved]] = last[moved]
            follows = moved & (seg + 1 < len(owner))
            lang, seg = lang[follows], seg[follows] + 1
            same = within[seg] > 0
            lang, seg = lang[same], seg[same]
        total = np.zeros((len(self.languages), len(lengths)))
        for row, c in zip(total, count + extra):
            row += np.bincount(owner, weights=c, minlength=len(lengths))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score (0 to 1) of each text, and whether a language explains it.

        The score is the language's share when each counts two to the minus its bits
        for the whole text.  UNDETERMINED and 0 where a text is null or has no letter:
        that isn't explained, and neither is a text of several letters no two of which
        follow each other in a reference.  Without references nothing with a letter is
        held against.
        """
        names: list[str] = []
        scores: list[np.ndarray] = []
        explained: list[np.ndarray] = []
        for chunk in _chunks([t or "" for t in texts]):
            symbols, lengths = self.reduce(chunk)
            if not self.languages:
                names += [UNDETERMINED] * len(chunk)
                scores.append(np.zeros(len(chunk)))
                explained.append(lengths > 0)
                continue
            parsed = self.phrases(symbols, lengths)
            bits = parsed * self.log_lengths[:, None]
            best = bits.argmin(axis=0)
            at = np.arange(len(chunk))
            names += [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), lengths.tolist())]
            scores.append(np.where(lengths > 0, 1 / np.exp2(bits[best, at] - bits).sum(axis=0), 0.0))
            explained.append((lengths > 0) & ((parsed.min(axis=0) < lengths) | (lengths <= 2)))
        joined = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return names, joined(scores, float), joined(explained, bool)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk: list[str] = []
    room = CHUNK
    for t in texts:
        if chunk and len(t) > room:
            yield chunk
            chunk, room = [], CHUNK
        chunk.append(t)
        room -= len(t)
    if chunk:
        yield chunk


def fit(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CrossParser:
    """A parser from a sample of the labelled rows: those of least hashed id, SAMPLE_DOCS a language.

    Only rows with a label, a text and `usable` true take part; of repeated rows of
    an id and label the smallest text counts.  The sample is bounded by SAMPLE_DOCS,
    SAMPLE_SYMBOLS and SAMPLE_TOTAL, and a sampled text gives no more than four times
    its equal share of its language's symbols; with no such row every prediction is
    UNDETERMINED.
    """
    from pyspark.sql import Window

    rows = own_columns(docs.where(usable) if usable is not None else docs, id=id_col, lang=lang_col, text=text_col)
    rows = rows.where("lang is not null and text is not null")
    # only ids whose hash is among the least few of their language, by its number of ids, are put in order
    place = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 31))).cast("long")
    sizes = checkpointed(rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")))
    sizes = F.broadcast(sizes) if sizes.count() <= LISTED_ROWS else sizes
    near = rows.select("id", "lang", place.alias("place")).join(sizes, "lang").where(F.col("place").cast("double") * F.col("n") < 4.0 * SAMPLE_DOCS * (1 << 31)).select("id", "lang", "place").distinct()
    order = Window.partitionBy("lang").orderBy("place", "id")
    picked = checkpointed(near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS).select("id", "lang"))
    languages = picked.select("lang").distinct().count()
    room = max(1, 4 * min(SAMPLE_SYMBOLS, SAMPLE_TOTAL // max(1, languages)) // SAMPLE_DOCS)
    if languages * SAMPLE_DOCS <= LISTED_ROWS:
        picked = F.broadcast(picked)
    met = rows.select("id", "lang", F.substring("text", 1, room).alias("text")).join(picked, [rows["id"].eqNullSafe(picked["id"]), rows["lang"] == picked["lang"]], "left_semi")
    texts: dict[str, list[str]] = {}
    for r in met.groupBy("id", "lang").agg(F.min("text").alias("text")).collect():
        texts.setdefault(r.lang, []).append(r.text)
    return CrossParser.fit(texts)


def predictor(parser: CrossParser):
    """A column function text -> struct(lang, score, explained) for the fitted parser."""

    @F.arrow_udf("struct<lang: string, score: double, explained: boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = []
            for lo in range(0, max(1, len(b)), SLICE):
                names, scores, explained = parser.predict(b.slice(lo, SLICE).to_pylist())
                parts.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(explained, pa.bool_())], fields=list(_RESULT)))
            yield pa.concat_arrays(parts)

    return predict


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score) per row; repeated rows give repeated results, an empty table an empty one."""
    rows = own_columns(docs, id=id_col, text=text_col)
    return rows.select("id", predictor(parser)("text").alias("p")).select("id", "p.lang", "p.score")


def learnable(id_col: str = "doc_id") -> Column:
    """The rows that training may use: crc32 of the id modulo 3 is not 1."""
    return id_fold(id_col, 3) != 1


def keep_identified(docs: DataFrame, parser: CrossParser, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text has no letter or is explained by no language; ties between languages stay."""
    name = "__language"
    marked = docs.withColumn(name, predictor(parser)(docs[text_col]))
    return marked.where(F.col(f"{name}.explained")).drop(name)
