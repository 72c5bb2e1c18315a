"""Packing documents into training sequences by lexical retrieval.

Documents are tokenised and a document's whole windows are cut off first.  What
is left of each document of a shard goes into a BM25 inverted index over token
ids.  A seed's window is then filled with its best unused neighbours, the last
of them cut where the window ends; what it has left stays unused for later
windows.  The end of a shard, where no neighbour is left, is cut into sequences
whose lengths are powers of two, so that nothing is padded.

Documents are dealt to shards by content.  Each has its terms of most BM25 weight
as key, with document frequencies of the whole table, and the table is sorted by
these keys over all its partitions.  A shard is a run of up to SHARD_DOCS rows of
that order, so copies and documents of the same leading terms meet wherever they
were in the input, and a key of more documents is split by the terms that follow.
Memory is bounded by a shard.  A neighbour of other leading terms may be in another
shard and is not found then.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, scratch

WINDOW = 1024
SHARD_DOCS = 512
#: Bytes of ids that a shard holds at most, but for its last document.
SHARD_BYTES = 64 << 20
END_ID = 0
#: Leading terms by which documents are sorted.
KEYS = 4
#: BM25's saturation and length weight.
K1, B = 1.2, 0.75

_VOCABULARY = "byte_bpe_50k.tiktoken"
_SPECIAL = {"<|endoftext|>": 50256}
_SEQUENCE_BITS = 40

PIECES = "doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file; it gives the ids of the tokenizer file of the same vocabulary."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=_SPECIAL)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The text's ids with the end id; null counts as empty."""
    enc = encoding(path)
    text = text or ""
    special = any(s in text for s in _SPECIAL)
    ids = enc.encode_to_numpy(text, allowed_special="all") if special else enc._core_bpe.encode_to_tiktoken_buffer(text, set())
    ids = ids if isinstance(ids, np.ndarray) else np.frombuffer(ids, dtype=np.uint32)
    return np.append(ids.astype("<u4"), np.uint32(END_ID)).astype("<u4")


@dataclass
class Statistics:
    """Of the rests of a table's documents: how many there are, their mean length, and by id how many hold it."""

    docs: int
    mean: float
    df: np.ndarray

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[terms]
        return np.log1p((self.docs - df + 0.5) / (df + 0.5))

    def leading(self, rest: np.ndarray) -> list[int]:
        """The KEYS terms of most weight that some other document holds too, -1 where there are fewer."""
        terms, tf = np.unique(rest, return_counts=True)
        shared = self.df[terms] > 1
        terms, tf = terms[shared], tf[shared]
        weight = self.idf(terms) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(rest) / self.mean))
        best = terms[np.lexsort((terms, -weight))[:KEYS]].tolist()
        return best + [-1] * (KEYS - len(best))


class Index:
    """BM25 over the rests of one shard's documents: postings by term, weights computed once.

    whole is the table's statistics; without it the shard's own count.
    """

    def __init__(self, rests: list[np.ndarray], whole: Statistics | None = None):
        n = self.n = len(rests)
        sizes = np.array([len(r) for r in rests], dtype=np.int64)
        pair = np.concatenate([r.astype(np.int64) for r in rests]) * n + np.repeat(np.arange(n), sizes)
        pair, tf = np.unique(pair, return_counts=True)
        term, self.doc = pair // n, pair % n
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.bounds = np.append(first, len(term))
        idf = whole.idf(self.terms) if whole else np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / (whole.mean if whole else sizes.mean()))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        by_doc = np.argsort(self.doc, kind="stable")
        self.of_doc = np.split(np.repeat(np.arange(len(self.terms)), df)[by_doc], np.cumsum(np.bincount(self.doc, minlength=n))[:-1])

    def scores(self, seed: int) -> np.ndarray:
        """Each document's score for the seed's distinct terms."""
        terms = self.of_doc[seed]
        lo, size = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_shard(ids: list[np.ndarray], window: int = WINDOW, whole: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each id once; all are full but for powers of two at the end."""
    out: list[list[tuple[int, int, int]]] = []
    at = []
    for k, x in enumerate(ids):
        full = len(x) // window * window
        out += [[(k, s, window)] for s in range(0, full, window)]
        at.append(full)
    docs = [k for k, x in enumerate(ids) if at[k] < len(x)]
    if not docs:
        return out
    index = Index([ids[k][at[k] :] for k in docs], whole)
    unused = np.ones(len(docs), dtype=bool)
    last: list[tuple[int, int, int]] = []
    for seed in sorted(range(len(docs)), key=lambda i: (at[docs[i]] - len(ids[docs[i]]), i)):
        if not unused[seed]:
            continue
        unused[seed] = False
        k = docs[seed]
        sequence, room = [(k, at[k], len(ids[k]) - at[k])], window - (len(ids[k]) - at[k])
        score = index.scores(seed) if room and unused.any() else None
        while room and unused.any():
            near = int(np.argmax(np.where(unused, score, -1.0)))
            k = docs[near]
            take = min(room, len(ids[k]) - at[k])
            sequence.append((k, at[k], take))
            at[k] += take
            room -= take
            unused[near] = at[k] < len(ids[k])
        if room:
            last = sequence
        else:
            out.append(sequence)
    return out + _powers(last)


def _powers(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The sequence cut into sequences whose lengths are descending powers of two."""
    left = sum(n for _, _, n in sequence)
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for k, start, n in sequence:
        while n:
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
                out.append([])
            take = min(room, n)
            out[-1].append((k, start, take))
            start, n, room = start + take, n - take, room - take
    return out


def pack(docs: DataFrame, vocabulary: str = _VOCABULARY, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece of a document: its ids (little-endian uint32) and its place in a sequence.

    doc_tokens is the document's length with its end id.  A null text is empty
    and gives the end id alone; repeated rows are packed as rows of their own; a
    null id is kept; an empty table gives no piece.  Each sequence is `window`
    long or, at a shard's end, a smaller power of two.
    """
    path_of = vocabulary
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession

    # ids travel in two bytes where the vocabulary allows, and leave in four
    narrow = _size(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary) <= 1 << 16
    held = np.dtype("<u2" if narrow else "<u4")

    def tokenised(it):
        path = public_tokenizers.path(path_of) if "/" not in path_of else path_of
        for b in it:
            for lo in range(0, b.num_rows, shard_docs):
                rows = b.slice(lo, shard_docs)
                data = [token_ids(t, path).astype(held).tobytes() for t in rows.column("text").to_pylist()]
                yield pa.record_batch([rows.column("id"), pa.array(data, pa.binary())], names=["id", "ids"])

    place = scratch(spark, "packing")
    own_columns(docs, id=id_col, text=text_col).mapInArrow(tokenised, f"id {kind}, ids binary").write.parquet(place)
    rows = spark.read.parquet(place)
    whole = statistics(rows, window, held)

    def keyed(it):
        for b in it:
            keys = np.array([whole.leading(_rest(x, window, held)) for x in b.column("ids").to_pylist()], dtype=np.int64).reshape(-1, KEYS)
            yield pa.record_batch([*b.columns, *(pa.array(keys[:, k]) for k in range(KEYS))], names=["id", "ids", *names])

    names = [f"k{k}" for k in range(KEYS)]
    order = [*names, F.xxhash64("ids"), F.xxhash64(F.col("id").cast("string"))]
    dealt = rows.mapInArrow(keyed, f"id {kind}, ids binary, " + ", ".join(f"{k} long" for k in names))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "ids")

    def batches(it):
        part = TaskContext.get().partitionId() << _SEQUENCE_BITS
        done = 0
        for rows in _runs(it, shard_docs):
            ids = [np.frombuffer(x, dtype=held).astype("<u4") for x in rows.column("ids").to_pylist()]
            doc, start, length, seq, offset, data = [], [], [], [], [], []
            for n, sequence in enumerate(pack_shard(ids, window, whole)):
                place = 0
                for k, s, m in sequence:
                    doc.append(k)
                    start.append(s)
                    length.append(m)
                    seq.append(part + done + n)
                    offset.append(place)
                    data.append(ids[k][s : s + m].tobytes())
                    place += m
            done = seq[-1] - part + 1
            total = np.array([len(x) for x in ids], dtype=np.int64)[doc]
            columns = [rows.column("id").take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())]
            columns += [pa.array(total), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return dealt.mapInArrow(batches, PIECES.format(kind=kind))


def _size(path: str) -> int:
    """One more than the greatest id of a vocabulary."""
    enc = encoding(path)
    return enc.max_token_value + 1


def _rest(data: bytes, window: int, held: np.dtype) -> np.ndarray:
    """What a document's whole windows leave of its ids."""
    ids = np.frombuffer(data, dtype=held)
    return ids[len(ids) // window * window :]


def _runs(batches, size: int, room: int = SHARD_BYTES):
    """The rows of all batches in runs of size, the last one shorter; a run ends early where its ids take `room` bytes."""
    kept: list[pa.RecordBatch] = []
    rows = taken = 0
    for b in batches:
        ends = np.cumsum([len(x) for x in b.column("ids").to_pylist()])
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            fits = int(np.searchsorted(ends, before + room - taken, side="right")) - at
            n = max(min(fits, size - rows), 0 if rows else 1)
            if n:
                kept.append(b.slice(at, n))
                taken += int(ends[at + n - 1]) - before
                rows, at = rows + n, at + n
            if rows == size or (at < b.num_rows and n >= fits):
                yield pa.concat_batches(kept)
                kept, rows, taken = [], 0, 0
    if kept:
        yield pa.concat_batches(kept)


def statistics(rows: DataFrame, window: int = WINDOW, dtype: np.dtype = np.dtype("<u4")) -> Statistics:
    """Over all rows of (ids binary); bounded by the vocabulary."""

    def counted(it):
        df = np.zeros(0, dtype=np.int64)
        docs = size = 0
        for b in it:
            rests = [r for r in (_rest(x, window, dtype) for x in b.column("ids").to_pylist()) if len(r)]
            docs, size = docs + len(rests), size + sum(map(len, rests))
            seen = np.bincount(np.concatenate([np.unique(r) for r in rests])) if rests else df[:0]
            if len(seen) > len(df):
                df, seen = seen, df
            df[: len(seen)] += seen
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [docs, size]))], names=["term", "n"])

    got = rows.select("ids").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(*(c.to_pylist() for c in got.columns)))
    docs, size = n.pop(-1, 0), n.pop(-2, 0)
    df = np.zeros(max(n, default=0) + 1, dtype=np.int64)
    df[list(n)] = list(n.values())
    return Statistics(docs, size / docs if docs else 1.0, df)
