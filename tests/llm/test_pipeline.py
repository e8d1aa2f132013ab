"""The whole pipeline against plain Python over the same rows."""
import json
import re
from collections import Counter
from math import log

import corpus_pipeline as P
import numpy as np
import pytest
import xxhash

from sensorlab.llm import quality_rules as Q

from .test_bpe import reference  # noqa: F401
from .test_decontam import brute as brute_hits
from .test_decontam import words
from .test_quality_rules import brute as brute_base
from .test_simhash import brute_components, brute_fp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def bucket(*tokens):
    h = 42
    for t in tokens:
        h = xxhash.xxh64_intdigest(t.encode(), h)
    return (h - (1 << 64) if h >> 63 else h) % Q.BUCKETS


def grams(text):
    t = re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]+", text or "")
    return [bucket(x) for x in t] + [bucket(a, b) for a, b in zip(t, t[1:], strict=False)]


def plain_quality(docs, labels):
    trusted = {i for i, q in labels if q == 1}
    g = [grams(d[1]) for d in docs]
    every = Counter(b for x in g for b in x)
    good = Counter(b for d, x in zip(docs, g, strict=True) if d[0] in trusted for b in x)
    ne, ng = sum(every.values()), sum(good.values())

    def ratio(b):
        return log((good[b] + Q.PRIOR) / (ng + Q.PRIOR * Q.BUCKETS)) - log((every[b] + Q.PRIOR) / (ne + Q.PRIOR * Q.BUCKETS))
    return [d for d, x in zip(docs, g, strict=True)
            if not brute_base(d[1])[5] and sum(map(ratio, x)) / max(len(x), 1) >= Q.THRESHOLD]


def plain_dedup(docs):
    fps = {d[1]: brute_fp(d[1]) for d in docs}
    comps = brute_components(set(fps.values()), 2)
    best = {}
    for d in docs:
        k = min(comps[fps[d[1]]])
        if k not in best or d[0] < best[k][0]:
            best[k] = d
    return list(best.values())


def plain_cut(docs, items):
    out = []
    for d in docs:
        n, hits, _ = brute_hits(d[1], items, 10)
        if hits > 0.5 * n:
            continue
        text = d[1]
        if hits:
            at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
            w, hit = words(text), set()
            for _, t in items:
                iw = words(t)
                size = min(10, len(iw))
                for i in range(len(iw) - size + 1 if size else 0):
                    for j in range(len(w) - size + 1):
                        if w[j:j + size] == iw[i:i + size]:
                            hit.update(range(j, j + size))
            kept, pos = [], 0
            runs = [(i, j) for i in sorted(hit) if i - 1 not in hit for j in [next(k for k in range(i, len(w) + 1) if k not in hit)]]
            for i, j in runs:
                kept.append(text[pos:at[i][0]])
                pos = at[j - 1][1]
            text = "".join([*kept, text[pos:]])
        out.append((d[0], text, d[2], d[3], d[4] if text == d[1] else len(text)))
    return out


def fixture_rows(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS).collect()]
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    return docs, labels, items


def test_run_against_plain_python(spark, reference):  # noqa: F811
    docs, labels, items = fixture_rows(spark)
    kept = plain_quality(docs, labels)
    assert 0 < len(kept) < len(docs)
    kept = [d for d in kept if any(c.isalpha() for c in d[1])]
    kept = plain_cut(plain_dedup(kept), items)
    got = P.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(kept)
    for r in got:
        assert r.intact and np.frombuffer(bytes(r.ids), "<u4").tolist() == reference.encode_ordinary(r.text)


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stage_gets_through_odd_rows(spark, make, tmp_path, name, stage):
    """Nulls, empty texts, repeated rows, extra columns with operators' names, empty tables."""
    from .conftest import ODD_TEXTS
    d = str(tmp_path)
    make([(1, "some words to match in a test item of ten words")], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    make([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    rows = [(i, t, None, "s", None, 1, "k") for i, t in enumerate(ODD_TEXTS * 2)] + [(None, None, None, None, None, None, None)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, score long, kept string"
    out = stage(spark, make(rows, schema), d)
    assert out.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "score", "kept"]
    assert name != "byte_bpe" or out.count() == len(rows)
    out.write.parquet(d + "/out")
    assert stage(spark, make([], schema), d).count() == 0


def test_stages_are_json_names():
    assert len(P.STAGES) == 5 and json.dumps([n for n, _ in P.STAGES])


def test_language_stage_drops_only_und(spark, make):
    """However many languages share the softmax: texts of two languages stay."""
    from .test_langid import many
    docs = [(i, t, g, "s", len(t)) for i, t, g in many(60)]
    docs += [(1000 + i, f"{docs[i][1]} {docs[-1][1]}", None, "s", 1) for i in range(5)] + [(2000, "12 34 !", None, "s", 7), (2001, None, None, "s", None)]
    df = make(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.keep_language(spark, df, "")
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs if d[0] < 2000}
