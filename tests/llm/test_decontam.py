import random
import re

from sensorlab.llm import decontam

from .conftest import ODD_TEXTS


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(window, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == iw[i:i + n]:
                    hit.update(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def table(seed, n_docs=60):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice("a b c d".split()) for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))) for i in range(12)]
    items += [(3, "a B, c; d"), (None, "b b b"), (40, None), (41, "é! é ñ")]
    docs = [(i, " ".join(rng.choice("a b c d e é ñ".split()) for _ in range(rng.choice([0, 1, 4, 30, 80])))) for i in range(n_docs)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "a b c d"), (5, docs[5][1])]
    return docs, items


def check(make, window, block_words):
    docs, items = table(window)
    got = decontam.find_spans(make(docs, "doc_id long, text string"), make(items, "item_id long, text string"),
                              window, block_words=block_words).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hits, ids = brute(r.text, items, window)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hits, ids)
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == hits
        raw, w = (r.text or "").encode(), words(r.text)
        for s in r.spans:
            assert words(raw[s["begin"]:s["end"]].decode()) == w[s["first"]:s["last"] + 1]


def test_against_brute_force(make):
    for window in (3, 4, 10):
        check(make, window, decontam.BLOCK_WORDS)


def test_blocks_of_items_give_the_same(make):
    check(make, 3, 4)


def test_remove_spans(make):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, "Keep this " + item.upper() + "! and that, with many more words all around it here now yes", "x"),
            (2, "only " + item, "y"), (3, None, "z"), (4, "clean", None), (4, "clean", None)]
    df = make(docs, "doc_id long, text string, spans string")
    out = {(r.doc_id, r.text, r.spans) for r in decontam.remove_spans(df, make([(1, item)], "item_id long, text string")).collect()}
    assert out == {(1, "Keep this ! and that, with many more words all around it here now yes", "x"), (3, None, "z"),
                   (4, "clean", None)}


def test_empty_tables(make):
    bench, none = make([(1, "a b")], "item_id long, text string"), make([], "item_id long, text string")
    docs = make([(1, "a b c")], "doc_id long, text string")
    assert decontam.find_spans(make([], "doc_id long, text string"), bench).count() == 0
    assert decontam.find_spans(docs, none).first().n_hit == 0


def test_blocks_make_passes(make, spark):
    """Twenty blocks: files from Spark tasks, one Python stage per pass, results as with one block."""
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(40))) for i in range(50)]
    docs = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(30)) + " " + items[i][1]) for i in range(50)]
    d, b = make(docs, "doc_id long, text string"), make(items, "item_id long, text string")
    assert len(decontam.build_automata(b, 10, block_words=100)) >= 15
    many = decontam.find_spans(d, b, 10, block_words=100)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    one = decontam.find_spans(d, b, 10)
    assert sorted(many.collect(), key=str) == sorted(one.collect(), key=str)
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in one.collect()} == {i: brute(t, items, 10) for i, t in docs}


def test_remove_spans_takes_one_python_stage(make):
    """One Python worker per core, and texts cut as plain Python cuts their bytes."""
    docs, items = table(4)
    df, bench = make(docs, "doc_id long, text string"), make(items, "item_id long, text string")
    got = decontam.remove_spans(df, bench, 3, 1.0)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = []
    for r in decontam.find_spans(df, bench, 3).collect():
        raw, at, kept = (r.text or "").encode(), 0, b""
        for x in r.spans:
            kept, at = kept + raw[at:x.begin], x.end
        want.append((r.doc_id or -1, "none" if r.text is None else (kept + raw[at:]).decode()))
    assert len({t for _, t in want}) > 20
    assert sorted((r.doc_id or -1, "none" if r.text is None else r.text) for r in got.collect()) == sorted(want)
