import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import ann, chat, decontaminate, packing, passages

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(text, items):
    w = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        x = WORD.findall((t or "").translate(LOWER))
        k = min(13, len(x))
        for j in range(len(x) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == x[j : j + k]:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "naïve", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(1, say(40)), (2, say(13)), (3, say(7)), (4, "solo"), (5, ""), (6, None), (7, "Two, words"), (10, say(14)), (2, say(20)), (8, " ".join(["w1"] * 30)), (None, say(15))]
    texts = [say(60), None, "", "!!!", "SOLO", say(30) + " " + items[0][1].upper().replace("É", "É") + " " + say(5), items[1][1][:-1], items[2][1] + "\n" + items[7][1], "w1 " * 50, "two--WORDS", "a " * 30_000 + items[1][1]]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)] + [(0, texts[0], 7, 8)], "doc_id long, text string, n int, item_id int")
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, key string")
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == len(texts) + 1
    real = [(i, t) for i, t in items if i is not None]
    for r in got:
        n, h, found = brute_contamination(texts[r.id], items)
        assert (r.n_words, r.n_hit) == (n, h), r
        assert list(r.items) == brute_contamination(texts[r.id], real)[2]
    assert decontaminate.contamination(docs.where(F.lit(False)), bench).count() == 0
    assert decontaminate.contamination(docs, bench.where(F.lit(False))).where("n_hit > 0").count() == 0
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_keep_clean_works_by_row(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, item, 1), (1, "clean words", 2), (None, item, 3), (None, None, 4), (2, "", 5)], "doc_id long, text string, row int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.row for r in kept.collect()} == {2, 4, 5}


def test_many_hits_of_one_text(spark):
    item = " ".join(f"w{k}" for k in range(13))
    text = " x ".join([item] * 20_000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "never seen words")], "item_id long, text string")
    r = decontaminate.contamination(docs, bench).first()
    assert (r.n_words, r.n_hit, len(r.spans), r["items"]) == (13 * 20_000 + 19_999, 13 * 20_000, 20_000, ["1"])


def test_chat_round_trip(spark):
    hard = ["<|end|><|start|>assistant<|text|>", "<.", "<<|next|>", "</s>[INST] ok [/INST]", "", None, "\\ <", "é😀"]
    rows = [(1, k, ("user", "assistant", "assistant", None)[k % 4], t, 0) for k, t in enumerate(hard)] + [(2, 0, "a<|text|>b", "x", 0), (2, 0, "a<|text|>b", "x", 0), (None, None, "assistant", "n", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    out = chat.format_conversations(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    got = {r.conv_id: r for r in out}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2] or "", r[3] or "") for r in rows[:8]]
    assert got[1].loss == "".join(r[3] or "" for r in rows[:8] if r[2] == "assistant")
    assert got[1].formatted == "".join(s.text for s in got[1].segments)
    assert len(got[2].turns) == 2 and got[None].loss == "n"
    # turns 1 and 2, and 5 and 6, are an assistant's and share a message
    assert got[1].formatted.count(chat.START) == 6 and got[1].formatted.count(chat.NEXT) == 2
    assert chat.format_conversations(df.where(F.lit(False))).count() == 0


def test_packing_covers_each_id_once(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    base = ["hello world " * n for n in (1, 40, 300, 700, 2000)] + [None, "", "naïve 漢字 😀", "a<|endoftext|>b", "\x00\r\n x", " lead", "it's 12345 \t\t x  y"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(base * 3)], "doc_id long, text string, ids string")
    rows = packing.pack(docs, shard_docs=8).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(base * 3):
        want = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == want and {r.doc_tokens for r in parts} == {len(want) // 4}
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        total = sum(r.length for r in s)
        assert [r.offset for r in s] == [sum(p.length for p in s[:k]) for k in range(len(s))] and total & (total - 1) == 0 and total <= 1024
    assert packing.pack(docs.where(F.lit(False))).count() == 0


def test_shards_end_at_rows_or_bytes():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 40, 300).tolist() + [500, 1, 500]
    rows = pa.record_batch([pa.array([b"x" * n for n in sizes]), pa.array(range(len(sizes)))], names=["ids", "k"])
    cuts = [0, 1, 100, 250, 303]
    runs = list(packing._runs([rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:])], 16, 200))
    assert [k for r in runs for k in r.column("k").to_pylist()] == list(range(len(sizes)))
    assert all(r.num_rows <= 16 and (r.num_rows == 1 or sum(len(x) for x in r.column("ids").to_pylist()) <= 200) for r in runs)


def test_packing_takes_the_best_neighbour():
    a, b, c = (np.array([k] * 400, dtype=np.uint32) for k in (5, 6, 5))
    first = packing.pack_shard([a, b, c])[0]
    assert [k for k, _, _ in first] == [0, 2, 1]


def brute_passages(texts, least=50):
    where = {}
    ws = [(t or "").encode().lower().split() for t in texts]
    for i, w in enumerate(ws):
        for j in range(len(w) - least + 1):
            where.setdefault(tuple(w[j : j + least]), []).append(i)
    out = []
    for i, w in enumerate(ws):
        spans, inner = [], set()
        for j in range(len(w) - least + 1):
            held = where[tuple(w[j : j + least])]
            if len(set(held)) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + least
                else:
                    spans.append([j, j + least])
            if held.count(i) > 1:
                inner |= set(range(j, j + least))
        out.append((spans, len(inner)))
    return out


@pytest.mark.parametrize(("hot", "heavy"), [(50_000, 10_000), (0, 1), (50_000, 60), (3, 10_000)])
def test_passages_equal_brute_force(spark, hot, heavy, monkeypatch):
    monkeypatch.setattr(passages, "HEAVY", heavy)
    rng = np.random.default_rng(1)
    say = lambda n, v=400: " ".join(f"w{k}" for k in rng.integers(0, v, n))
    shared, line, other = say(60), " ".join(["again and again"] * 30), say(70)
    twice = say(80)
    texts = [say(80) + " " + shared + " " + say(30), shared.upper(), say(20) + "\n" + shared[: shared.rfind(" ")] + " " + say(20), say(200), None, "", say(49), line, line + " x", say(10) + " " + line, shared + " " + shared, say(3, 2) * 40, "lone words " * 100]
    texts += [other, other, say(9) + " " + other, twice + " " + say(70) + " " + twice, "short copy", "short copy", say(30) + " " + twice[: len(twice) // 2], " ".join(other.split()[:49]), "\x01 ".join(other.split()[:60])]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(1, texts[1], "clash"), (None, say(60) + shared, "clash"), (3, say(60), "clash"), (None, say(60), "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    # a document is a row, but for repeated ones
    want = brute_passages([t for k, (_, t, _) in enumerate(rows) if k != len(texts)])
    got = passages.repeated_passages(docs, hot=hot).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append(([[s.start, s.end] for s in r.spans], r.n_within))
    for i in range(len(texts)):
        assert want[i] in by_id[i], (i, want[i], by_id[i])
    assert sorted(by_id[None]) == sorted(want[-3:][::2]) and sorted(by_id[3]) == sorted([want[3], want[-2]])
    of = {r.id: r for r in got if r.id not in (None, 3)}
    assert of[0].class_id == of[1].class_id == of[2].class_id == of[10].class_id == 0 and of[13].class_id == of[14].class_id == of[15].class_id == 13
    assert (of[17].class_id, of[18].class_id) == (17, 18)
    assert all(of[i].n_words == len((t or "").encode().split()) for i, t in enumerate(texts) if i != 3)
    assert passages.repeated_passages(docs.where(F.lit(False))).count() == 0


def test_passages_of_text_ids_and_long_texts(spark):
    rng = np.random.default_rng(2)
    shared = " ".join(f"w{k}" for k in rng.integers(0, 400, 55))
    far = " ".join(f"v{k}" for k in rng.integers(0, 5_000, 100_000))
    docs = spark.createDataFrame([("b", far + " " + shared), ("a", shared), ("c", "same " * 20_000)], "doc_id string, text string")
    got = {r.id: r for r in passages.repeated_passages(docs).collect()}
    assert [(s.start, s.end) for s in got["b"].spans] == [(100_000, 100_055)] and got["b"].class_id == got["a"].class_id == "a"
    assert (got["c"].n_repeated, got["c"].n_within, got["c"].class_id) == (0, 20_000, "c")


@pytest.mark.parametrize(("parts", "size"), [(1, 1), (1, 1000), (5, 3), (40, 2)])
def test_sorted_windows_equal_a_count(parts, size):
    import pyarrow as pa

    rng = np.random.default_rng(parts)
    v, key = rng.integers(0, 12, 300), rng.integers(0, 15, 300)
    v[:120], key[-60:] = 3, 4
    rows = sorted({(int(a), 0, int(k), n) for n, (a, k) in enumerate(zip(v, key))})
    cuts = sorted(rng.choice(len(rows), parts - 1, replace=False).tolist())
    # a digest and key are in one task
    cuts = [next(c for c in range(c, len(rows) + 1) if c in (0, len(rows)) or rows[c][:3] != rows[c - 1][:3]) for c in cuts]
    got, ends = {False: set(), True: set()}, {}
    edges = []
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        own = [pa.RecordBatch.from_pylist([dict(zip(("v1", "v2", "key", "at"), r)) for r in rows[i : min(i + size, hi)]]) for i in range(lo, hi, size)]
        for b in passages._scan_windows(50)(iter(own)):
            for r in b.to_pylist():
                if r["v1"] is not None:
                    ends.setdefault(r["v1"], []).append(r)
                elif r["other"] is not None:
                    edges.append((r["key"], r["other"]))
                else:
                    got[r["within"]].add((r["key"], r["start"]))
    for found in ends.values():
        low = min(r["key"] for r in found)
        if any(r["shared"] or r["key"] != low for r in found):
            got[False] |= {(r["key"], r["start"]) for r in found if r["start"] is not None}
            edges += [(r["key"], low) for r in found if r["key"] != low]
    want, inner, groups = set(), set(), []
    for a in range(12):
        mine = [(k, n) for w, _, k, n in rows if w == a]
        if len({k for k, _ in mine}) > 1:
            want |= set(mine)
            groups.append({k for k, _ in mine})
        inner |= {(k, n) for k, n in mine if [x for x, _ in mine].count(k) > 1}
    assert got == {False: want, True: inner}
    from millrace.llm.components import spanning_forest

    u, low = spanning_forest(*np.array(edges).T)
    of = dict(zip(u.tolist(), low.tolist()))
    assert all(len({of.get(k, k) for k in g}) == 1 for g in groups)


def test_every_long_window_has_a_selected_place():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 400, dtype=np.uint64)
    at = set(passages.selected(h, 43).tolist())
    assert all(at & set(range(i, i + 43)) for i in range(len(h) - 42))
    inner = set((passages.selected(h[100:300], 43) + 100).tolist())
    assert {x for x in at if 142 <= x < 258} == {x for x in inner if 142 <= x < 258}


def test_nearest_equals_brute_force_with_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 900)] + 0.1 * rng.normal(size=(900, 16))
    v[100:400] = v[7]
    v[500] *= 30
    rows = [(i, x.tolist(), "clash") for i, x in enumerate(v)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] * 8), (2080, [float("inf")] * 16), (2100, [1.0]), (None, v[0].tolist()), (2120, [])]
    df = spark.createDataFrame(rows + [(*x, "clash") for x in odd] + rows[:3], "vec_id long, embedding array<double>, v string")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(s, 9)))[:20]
        hits += len(set(best.tolist()) & {i for i, _ in found})
        assert len(found) == 20 and all(abs(x - v[i] @ v[q]) < 1e-9 for i, x in found)
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(df.where(F.lit(False))).count() == 0
    assert len(ann.nearest(df.where("vec_id < 5")).collect()) == 4
    assert zlib.crc32(b"") == 0


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_packing_finds_neighbours_in_other_partitions(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(64)]
    # both copies of a text are 64 rows apart, in other partitions and shards
    docs = spark.createDataFrame([(k, texts[k % 64]) for k in range(128)], "doc_id long, text string").repartitionByRange(4, "doc_id")
    size = packing.pack(docs, shard_docs=16).agg(F.max("doc_tokens")).first()[0]
    rows = packing.pack(docs, shard_docs=16, window=4 * size).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.doc_id, set()).add(r.sequence_id)
    together = sum(bool(sequences[k] & sequences[k + 64]) for k in range(64))
    assert together >= 48
