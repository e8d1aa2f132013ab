import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sensorlab.llm import quality_rules as Q

from .conftest import ODD_TEXTS

SPACE = "[^\x20\x09-\x0D]+"


def brute(text):
    t = text or ""
    w = re.findall(SPACE, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed


TEXTS = [*ODD_TEXTS, "a b a b a b a", "a a a", "a a a a", "x\n x\nx\n\nx\n \n\n", "a b c d a b c e a b", "é ü é ü é ü #$ 😀 😀",
         " lead and trail ", "\x0bvt\x0cff", "\x85nel nbsp 　x", " ".join(str(i % 70) for i in range(300)),
         " ".join(str(i) for i in range(60)) + "\n" + " ".join(str(i) for i in range(10))]


def test_base_counts(make):
    got = Q.base_counts(make([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")).collect()
    for r in got:
        assert tuple(r[c] for c in Q.BASE) == brute(r.text), repr(r.text)[:80]
    assert len(got) == len(TEXTS)


def clean(i):
    rng = random.Random(i)
    return " ".join(f"word{rng.randrange(900)} the" for _ in range(60))


def corpus(make):
    docs = [(i, clean(i)) for i in range(60)] + [(100 + i, re.sub(r" ", " | ", clean(i + 60))) for i in range(15)]
    docs += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, clean(3)), (7, clean(7))]
    labels = [(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(5)] + [(None, 1), (4, None), (2, 1)]
    return docs, make(docs, "doc_id long, text string"), make(labels, "doc_id long, quality int")


def test_ratio_and_verdict(make, spark):
    docs, d, labels = corpus(make)
    got = Q.apply_rules(d, labels).collect()
    assert len(got) == len(docs)
    # brute force over the same hash buckets
    grams = {}
    for t in {t for _, t in docs}:
        tok = re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]+", t or "")
        grams[t] = [(x,) for x in tok] + list(zip(tok, tok[1:], strict=False))
    flat = sorted({g for v in grams.values() for g in v})
    one = {g: b for g, b in zip(flat, (r.b for r in spark.createDataFrame(
        [(i, g[0], g[1] if len(g) > 1 else None) for i, g in enumerate(flat)], "i int, x string, y string").select(
        "i", F.pmod(F.when(F.col("y").isNull(), F.xxhash64("x")).otherwise(F.xxhash64("x", "y")), F.lit(Q.BUCKETS)).alias("b"))
        .orderBy("i").collect()), strict=True)}
    from math import log
    trusted = set(range(0, 60, 2))
    every = Counter(one[g] for _, t in docs for g in grams[t])
    good = Counter(one[g] for i, t in docs if i in trusted for g in grams[t])
    ne, ng = sum(every.values()), sum(good.values())

    def ratio(b):
        return (log((good[b] + Q.PRIOR) / (ng + Q.PRIOR * Q.BUCKETS)) - log((every[b] + Q.PRIOR) / (ne + Q.PRIOR * Q.BUCKETS)))
    for r in got:
        g = grams[r.text]
        want = sum(ratio(one[x]) for x in g) / len(g) if g else 0.0
        assert abs(r.llr - want) < 1e-9
        assert r.kept == (not brute(r.text)[5] and r.llr >= Q.THRESHOLD)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(60)) <= kept and not kept & set(range(100, 115))


def test_no_labels_and_empty(make):
    _, d, labels = corpus(make)
    assert {r.llr for r in Q.apply_rules(d, labels.where("false")).select("llr").collect()} == {0.0}
    assert Q.apply_rules(d.where("false"), labels).count() == 0


def test_every_trusted_document_counts(make, spark):
    """Labels of ids without a document take no trusted document's place."""
    _, d, labels = corpus(make)
    elsewhere = spark.range(10**6, 10**6 + 200_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    want = sorted((r.doc_id or -1, r.llr) for r in Q.apply_rules(d, labels).collect())
    got = sorted((r.doc_id or -1, r.llr) for r in Q.apply_rules(d, labels.unionByName(elsewhere)).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert max(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) < 1e-9


def test_mistaken_ids_are_taken_off(make, monkeypatch):
    """A bitmap of one word lets most ids through; the counts are the same."""
    from sensorlab.llm import membership
    _, d, labels = corpus(make)
    want = Q.fit_ratio(d, labels).first().ratio
    monkeypatch.setattr(membership, "WORDS", 1)
    assert Q.fit_ratio(d, labels).first().ratio == want


def test_only_trusted_texts_are_counted_again(make, monkeypatch):
    """The texts whose grams are counted a second time are the trusted ones, however many ids are trusted or not."""
    from sensorlab.llm import membership
    _, d, labels = corpus(make)
    monkeypatch.setattr(membership, "WORDS", 1)
    seen, rows = [], Q._gram_rows
    monkeypatch.setattr(Q, "_gram_rows", lambda docs, *a: seen.append(docs) or rows(docs, *a))
    Q.fit_ratio(d, labels)
    trusted = d.join(labels.where("quality = 1"), "doc_id", "left_semi").where("text IS NOT NULL").count()
    assert sorted(x.count() for x in seen) == sorted([d.count(), trusted])


def test_grams_are_counted_without_lambdas(make, spark):
    """Spark evaluates lambdas node by node; counting the grams of every text needs none."""
    rows = Q._gram_rows(make(list(enumerate(TEXTS)), "doc_id long, text string"), F.col("text"), Q.BUCKETS, F.col("doc_id"))
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    tokens = [(i, re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]+", t)) for i, t in enumerate(TEXTS) if t]
    grams = [(i, x, None) for i, t in tokens for x in t] + [(i, x, y) for i, t in tokens for x, y in zip(t, t[1:], strict=False)]
    want = spark.createDataFrame(grams, "i long, x string, y string").select(
        "i", F.pmod(F.when(F.col("y").isNull(), F.xxhash64("x")).otherwise(F.xxhash64("x", "y")), F.lit(Q.BUCKETS)))
    assert Counter(map(tuple, rows.select("doc_id", "b").collect())) == Counter(map(tuple, want.collect()))
