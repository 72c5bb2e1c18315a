import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import langid
from millrace.llm.common import table

from .test_joins import brute_contamination
from .test_secrets import LEAST, PATTERNS
from .test_simhash import brute_fp, classes

SF = "/root/testdata/sf0.001"
MORE = [re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")]


def redacted(text):
    spans = [m.span() for kind, p in PATTERNS for m in p.finditer(text) if len(m[2] if kind == "assign" else m[0]) >= LEAST.get(kind, 12)]
    spans += [m.span() for p in MORE for m in p.finditer(text)]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:]


def test_stages_have_their_form(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "contamination", "secrets", "packing"]
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    parser = langid.fit(table(spark, SF, "documents"), langid.learnable())
    kept = [i for i, explained in zip(docs, parser.predict(list(docs.values()))[2]) if explained]
    group = classes(kept, [brute_fp(docs[i]) for i in kept])
    kept = [i for i in kept if group[i] == i]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    texts = {}
    for i in kept:
        n, hit, _ = brute_contamination(docs[i], items)
        if not (hit and 20 * hit >= n):
            texts[i] = redacted(docs[i])
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        parts = sorted(got[i], key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts)
