import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, lm, toxicity
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_phrases(text, reference):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in reference:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def test_phrases_equal_greedy_parsing():
    parser = langid.CrossParser.fit({"aa": ["the cat sat on the mat and the dog"], "bb": ["der hund und die katze sind da"]})
    texts = ["the hund sat", "zzz", "mat and die katze on", "x"]
    symbols, lengths = parser.reduce(texts)
    got = parser.phrases(symbols, lengths)
    for row, ref in zip(got, ["the cat sat on the mat and the dog ", "der hund und die katze sind da "]):
        assert row.tolist() == [brute_phrases(t + " ", ref) for t in texts]


@pytest.mark.parametrize("segment", [7, 64, 1024])
def test_phrases_of_long_texts_equal_greedy_parsing(segment, monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = np.random.default_rng(8)
    say = lambda letters, n: "".join(rng.choice(list(letters), n))
    references = {"aa": say("ab ", 900) + "z", "bb": say("abcdé ", 900), "cc": "ab" * 400}
    parser = langid.CrossParser.fit({k: [v] for k, v in references.items()})
    texts = [say("ab ", 5_000), say("abcdé ", 3_000), "ab" * 2_000, say("abz漢 ", 2_000), "b", "ab" * 600 + say("cd", 50) + "ab" * 600, ""]
    symbols, lengths = parser.reduce(texts)
    back = {0: " ", 1: "\0", **{k + 2: c for k, c in enumerate(parser.letters)}}
    said = lambda part: "".join(back[x] for x in part.tolist())
    read = [said(part) for part in np.split(symbols, np.cumsum(lengths)[:-1])]
    spaced = {k: said(parser.reduce([v])[0]) for k, v in references.items()}
    got = parser.phrases(symbols, lengths)
    for row, lang in zip(got, parser.languages):
        assert row.tolist() == [brute_phrases(t, spaced[lang]) for t in read], lang


def test_scripts_of_many_letters_are_told_apart():
    rng = np.random.default_rng(9)
    han, other = [chr(0x4E00 + k) for k in range(3_000)], [chr(0x4E00 + k) for k in range(3_000, 6_000)]
    pairs = lambda letters: [a + b for a, b in zip(rng.permutation(letters), rng.permutation(letters))]
    words = {"x1": pairs(han), "x2": pairs(other), "en": ["the", "cat", "dog"]}
    say = lambda k, n: "".join(rng.choice(words[k], n)) if k != "en" else " ".join(rng.choice(words[k], n))
    parser = langid.CrossParser.fit({k: [say(k, 9_000)] for k in words})
    assert len(parser.letters) > 5_000 and len(parser.cells) * 8 < 4_000_000
    assert parser.predict([say("x1", 30), say("x2", 30), say("en", 4)])[0] == ["x1", "x2", "en"]


def test_shares_of_a_sample_are_equal():
    parser = langid.CrossParser.fit({"aa": ["abc " * 50_000, "xyz " * 50_000, "xyz " * 50_000, "kl"]})
    text = "kl " + "abc " * 10 + "xyz " * 10
    symbols, lengths = parser.reduce([text])
    assert parser.phrases(symbols, lengths)[0, 0] <= 8


def test_predictions_of_odd_texts(spark):
    parser = langid.CrossParser.fit({"en": ["the cat sat on the mat " * 20], "de": ["der hund und die katze " * 20]})
    rows = [(1, "the mat"), (2, "DIE KATZE!"), (3, None), (4, ""), (5, "123 !?"), (6, "漢字"), (6, "漢字"), (7, "der hund " * 20_000), (8, "A."), (9, "ш")]
    docs = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, lang string")
    got = [(r.id, r.lang) for r in langid.identify(docs, parser).orderBy("id").collect()]
    assert got[:5] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")] and got[5][1] in ("de", "en") and got[5] == got[6] and got[7] == (7, "de")
    assert all(0 <= r.score <= 1 for r in langid.identify(docs, parser).collect())
    kept = langid.keep_identified(docs, parser)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 7, 8, 9}
    nothing = langid.CrossParser.fit({})
    assert nothing.predict(["abc", None])[0] == ["und", "und"]
    assert langid.keep_identified(docs, nothing).count() == 7
    assert langid.identify(docs.where(F.lit(False)), parser).count() == 0
    assert langid.fit(docs.where(F.lit(False))).languages == []
    # repeated rows of a sampled id, and rows without one, are one text each
    many = spark.createDataFrame([(1, "aa bb", "x")] * 500 + [(None, "cc dd", "y")] * 500, "doc_id long, text string, lang string")
    assert langid.fit(many).languages == ["x", "y"] and len(langid.fit(many).base) < 30


def test_language_accuracy_held_out(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op2_langid"](spark, SF).join(truth, "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()


def test_lm_base_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(100_003, None), (100_004, ""), (100_005, "one\vtwo three ONE")], "doc_id long, text string"))
    rows = {r.doc_id: (r.text or "").encode().lower().split() + [b" "] for r in docs.collect()}
    seen = Counter(w for i, ws in rows.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(seen.values()), len(seen)
    model = lm.fit(docs, lm.learnable())
    assert (model.tokens, model.vocabulary) == (n, v)
    got = {r.id: r for r in lm.score(docs, model).collect()}
    for i, ws in rows.items():
        assert (got[i].n_tokens, got[i].n_known) == (len(ws), sum(w in seen for w in ws))
        assert got[i].base_score == pytest.approx(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_distributions_sum_to_one(spark):
    texts = ["a b c a b d a b c", "a b c", "b a b c", "c c a b d"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.fit(docs)
    vocabulary = ["a", "b", "c", "d", "never"]
    for prefix in ("", "a", "a b", "c c a"):
        probe = spark.createDataFrame([(k, f"{prefix} {w}") for k, w in enumerate(vocabulary)] + [(99, prefix)], "doc_id long, text string")
        s = {r.id: r.score for r in lm.score(probe, model).collect()}
        tree = lm.pickle.loads(model.packed)
        flat, tokens = tree.numbers([f"{prefix} {w}".encode() for w in vocabulary])
        own = tree.log10(flat, lm._starts(tokens))
        first = lm._starts(tokens)
        last = [f + len(t) - 1 for f, t in zip(first, tokens)]
        # the word before the end; a word never seen is one more symbol of the root
        root = 0.5 / (model.tokens + 0.5 * (model.vocabulary + 1))
        p = [10 ** own[k] for k in last]
        p[-1] *= root
        end_flat, end_tokens = tree.numbers([prefix.encode()])
        p.append(10 ** tree.log10(end_flat, lm._starts(end_tokens))[-1])
        assert sum(p) == pytest.approx(1.0, abs=1e-9)
        assert all(math.isfinite(x) for x in s.values())


def test_lm_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = lm.fit(docs.where(F.lit(False)))
    assert [r.n_known for r in lm.score(docs, model).collect()] == [0, 0]
    assert lm.score(docs.where(F.lit(False)), lm.fit(docs)).count() == 0


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=60), (rng.random(60) < 0.5).astype(float)
    at, value = toxicity.isotonic(x, y)
    fit = np.interp(np.sort(x), at, value)
    ys = y[np.argsort(x)]
    brute = [max(min(ys[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.all(np.diff(fit) >= -1e-12) and np.allclose(fit, brute)


def test_toxicity_learns_words(spark):
    rng = np.random.default_rng(0)
    filler = [f"w{k}ord" for k in range(50)]
    rows, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        ws = list(rng.choice(filler, 40)) + (["vilest"] if bad else [])
        rows.append((i, " ".join(ws), "x"))
        labels.append((i, int(bad), "x"))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "you are the v1lest", "x"), (None, "vilest", "x")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (5, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, known, toxicity.learnable())
    assert "vilest" in {w for w in model.lexicon} and len(model.lexicon) < 5
    got = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 804 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.98
    assert got[1000] == got[1001] < 0.5
    empty = toxicity.fit(docs, known.where(F.lit(False)))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert toxicity.score(docs.where(F.lit(False)), model).count() == 0


def test_runs_of_letters_are_read_once():
    import time

    began = time.monotonic()
    x = toxicity.features(["a" * 1_000_000, "a1" * 300_000, "v1lest l.0.l a1b2c x@ @y"], {"vilest": 2.0})
    assert time.monotonic() - began < 30
    assert x[0, toxicity.FEATURES.index("obfuscated")] == 0
    plain = re.compile(r"[^\W\d_]+[0-9@$!*|][0-9@$!*|.\-]*[^\W\d_]+")
    rng = np.random.default_rng(6)
    for _ in range(300):
        text = "".join(rng.choice(list("ab1@. -_é"), 30))
        assert toxicity._MIXED.findall(text) == plain.findall(text)


def test_no_word_that_passes_the_test_is_cut(spark):
    # a word in 40 of 500 toxic and 60 of 9,500 clean documents, and 2,500 words that only toxic ones have
    rows, labels = [], []
    for i in range(10_000):
        bad = i < 500
        words = ["common", f"x{i}"]
        words += ["telling"] if i < 40 or 500 <= i < 560 else []
        words += [f"rare{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(2_500)] if i < 30 else []
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, known).lexicon
    assert "telling" in lexicon and len(lexicon) == 2_501 and "common" not in lexicon


def test_repeated_rows_of_a_sampled_id_are_one(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} here") for i in range(200)] * 5, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    once = toxicity.fit(docs.distinct(), known)
    again = toxicity.fit(docs, known)
    assert again.lexicon == once.lexicon and again.trees.base == once.trees.base


def test_lm_scores_do_not_depend_on_what_the_tree_holds(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0")
    whole = {r.id: r for r in lm.score(docs, lm.fit(docs, lm.learnable())).collect()}
    monkeypatch.setattr(lm, "WORD_SHARE", 2e-3)
    monkeypatch.setattr(lm, "PAIR_SHARE", 2e-3)
    model = lm.fit(docs, lm.learnable())
    got = {r.id: r for r in lm.score(docs, model).collect()}
    assert len(lm.pickle.loads(model.packed).levels[0].n) < 500
    for i, r in whole.items():
        assert (got[i].n_tokens, got[i].n_known) == (r.n_tokens, r.n_known)
        assert got[i].base_score == pytest.approx(r.base_score) and got[i].score == pytest.approx(r.score)
    assert any(abs(r.score - r.base_score) > 1 for r in whole.values())
