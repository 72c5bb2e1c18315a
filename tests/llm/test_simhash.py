import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import components, simhash
from millrace.llm.components import connected_components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def classes(ids, fps, radius=3):
    root = dict(zip(ids, ids))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_matches_brute_force(spark):
    base = " ".join(f"word{k % 37}" for k in range(90))
    texts = [base, base, base + " tail", "", None, "A b", "a B", "one", " \t\n", "x " * 400, base.upper(), base.replace("word5", "other")]
    docs = spark.createDataFrame([(i * 3, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    ids = [i * 3 for i in range(len(texts))]
    fps = [brute_fp(t) for t in texts]
    want = classes(ids, fps)
    assert {i: got[i][0] % 2**64 for i in ids} == dict(zip(ids, fps))
    assert {i: got[i][1] for i in ids} == want


@pytest.mark.parametrize("seed", [0, 1])
def test_links_equal_all_pairs_on_close_fingerprints(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 25, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    fps = [int(c) for c in centres]
    for c in centres:
        for _ in range(20):
            x = int(c)
            for k in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(k)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = classes(signed, fps)
    assert len({got.get(f, f) for f in signed}) == len(set(want.values()))
    assert len({(got.get(f, f), want[f]) for f in signed}) == len(set(want.values()))


@pytest.mark.parametrize("block", [16, 2048])
def test_every_pair_within_three_bits_meets_in_a_cell(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    pairs = []
    for k in range(300):
        x = int(rng.integers(0, 2**63))
        y = x
        for bit in rng.choice(64, 1 + k % 4, replace=False):
            y ^= 1 << int(bit)
        pairs.append((x, y))
    flat = [(f - 2**64 if f >> 63 else f,) for pair in pairs for f in pair]
    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(spark.createDataFrame(flat, "fp long"))).collect()}
    for k, (x, y) in enumerate(zip(flat[::2], flat[1::2])):
        assert (x[0] in got and got[x[0]] == got.get(y[0])) == (k % 4 < 3)


def test_large_cell_goes_by_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    fp = np.array([1 << (k % 60) for k in range(100)], dtype=np.uint64)
    u, v = simhash._cell_links(fp, np.zeros(100, dtype=bool), 3)
    assert set(v) == {1} and len(u) == 59


def test_components_of_a_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 905), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 905: 900}
    assert connected_components(chain.where("u > 9999")).count() == 0


@pytest.mark.parametrize("heavy", [1, 4, 10_000])
def test_components_with_hubs(spark, monkeypatch, heavy):
    monkeypatch.setattr(components, "HEAVY", heavy)
    edges = [(500, i) for i in range(501, 700)] + [(40, i) for i in range(600, 650)] + [(700, 701)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {40: 40, **{i: 40 for i in range(500, 700)}, 700: 700, 701: 700}


def test_empty_table_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [1, 1, 1]
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_links_run_through_rows_without_an_id_and_ids_may_be_text(spark):
    base = " ".join(f"word{k}" for k in range(60))
    fps = {}
    # a chain of texts in which each is near the next one, held by a row without an id in its middle
    for k in range(400):
        text = base + f" t{k}"
        fps.setdefault(brute_fp(text), text)
    near = [(a, b, c) for a in fps for b in fps for c in fps if (a ^ b).bit_count() <= 3 and (b ^ c).bit_count() <= 3 and (a ^ c).bit_count() > 3][:1]
    a, b, c = (fps[x] for x in near[0])
    docs = spark.createDataFrame([("p", a), (None, b), ("q", c), ("z", "far " * 9)], "doc_id string, text string")
    got = {r.id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {"p": "p", None: "p", "q": "p", "z": "z"}


def test_keep_first_works_by_row(spark):
    a, b = "alpha beta gamma delta epsilon", "one two three four five six"
    rows = [(1, a, 0), (2, a, 0), (2, b, 0), (None, a, 0), (None, "lonely words here", 0), (7, b, 0), (2, b, 0), (None, "lonely words here", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect())
    assert len(got) == 3 and [(x, t) for _, x, t in got] == [(1, a), (2, b), (None, "lonely words here")]
    assert simhash.keep_first(docs.where(F.lit(False))).count() == 0
