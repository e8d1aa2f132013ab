import numpy as np
from pyspark.sql import functions as F

from sensorlab.llm import langid
from sensorlab.llm.labelled import held_out

from .conftest import ODD_TEXTS


def rows(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return langid.presence(np.frombuffer(b"".join(raw), np.uint8), off)


def grams(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    low = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low)
    return {low[i:i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}


def test_presence_is_the_set_kernel():
    """Shared hashed n-grams are the shared n-grams, up to hash collisions."""
    texts = ["Hello, world", "hello World!", "", "x", "été à Noël", "Éte", "aaaa", "the cat sat on the mat " * 5]
    x = rows(texts).astype(int)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(int(x[i] @ x[j]) - len(grams(a) & grams(b))) <= 1
    assert (rows(["ab", "cd"]) == np.concatenate([rows(["ab"]), rows(["cd"])])).all()


def test_folded_weights_are_nystroem_ridge_regression():
    """The matrix product gives what kernel values to landmarks give."""
    rng = np.random.default_rng(1)
    words = {"a": ["alpha", "beta", "gamma"], "b": ["uno", "dos", "tres"], "c": ["eins", "zwei", "drei"]}
    texts, y = [], []
    for k in range(60):
        lang = "abc"[k % 3]
        texts.append(" ".join(rng.choice(words[lang], 6)) + f" w{k}")
        y.append(lang)
    x = rows(texts)
    model = langid.solve([r.tobytes() for r in np.packbits(x, axis=1)], y, landmarks=12)
    f = x.astype(float)
    f /= np.sqrt(f.sum(axis=1, keepdims=True))
    land = np.concatenate([np.flatnonzero(np.array(y) == c)[:4] for c in "abc"])
    k_mm, k_nm = f[land] @ f[land].T, f @ f[land].T
    value, vector = np.linalg.eigh(k_mm)
    good = value > 1e-6 * value[-1]
    phi = k_nm @ (vector[:, good] / np.sqrt(value[good]))
    one = np.where(np.array(y)[:, None] == np.array(list("abc")), 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + langid.RIDGE * len(y) * np.eye(phi.shape[1]), phi.T @ one)
    assert np.abs(model.scores(x) - phi @ beta).max() < 1e-3
    assert [model.languages[i] for i in model.scores(x).argmax(axis=1)] == y


def test_odd_texts(make):
    texts = [*ODD_TEXTS, "123 456 !!", "漢字"]
    docs = [(i, t, "en" if i % 2 else None, 5) for i, t in enumerate(texts)] + [(None, "le chat", "fr", 1), (7, "le chat", "fr", 1)]
    df = make(docs, "doc_id long, text string, lang string, score int")
    out = langid.identify(df, langid.fit(df, F.lit(True))).collect()
    assert len(out) == len(docs)
    for r in out:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1
        assert not letter or r.lang_pred in ("en", "fr")


def test_nothing_to_learn(make):
    df = make([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.fit(df, F.lit(True)) is None
    assert langid.identify(df, None).first().lang_pred == "und"
    assert langid.fit(df.where("false"), F.lit(True)) is None


def test_held_out_accuracy(spark):
    from sensorlab.llm.queries import QUERIES
    d = "/root/testdata/sf0.01"
    got = QUERIES["op4_langid"](spark, d).join(spark.read.parquet(d + "/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in got.collect() if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)
    ids = spark.read.parquet(d + "/documents.parquet").where(held_out("doc_id", 3, 1)).count()
    assert len(held) == ids


def many(languages, each=3):
    """Texts of made-up languages, each with words of its own."""
    rng = np.random.default_rng(5)
    out = []
    for k in range(languages):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(8)]
        out += [(k * each + i, " ".join(rng.permutation(words)), f"l{k}") for i in range(each)]
    return out


def test_more_languages_than_plan_branches(make):
    docs = many(450)
    df = make(docs, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert model.languages == sorted({d[2] for d in docs})
    got = langid.identify(df, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(docs)


def test_ranked_draw_is_the_branched_draw(make, monkeypatch):
    from sensorlab.llm import labelled
    df = make([(i, "abcd"[i * i % 7 % 4]) for i in range(3000)], "id long, g string")
    branched = {tuple(r) for r in labelled.take_by_hash(df, "g", "id", 40).collect()}
    monkeypatch.setattr(labelled, "BRANCHES", 1)
    assert len(branched) == 40 * df.select("g").distinct().count()
    assert {tuple(r) for r in labelled.take_by_hash(df, "g", "id", 40).collect()} == branched


def test_many_languages_stay_small():
    """A thousand languages: a kilobyte each beside the landmarks, and the same values as the folded matrix."""
    rng = np.random.default_rng(3)
    texts = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i:04d} " * 6 for i in range(1000)] * 2
    raw = [t.encode() for t in texts]
    x = langid.presence(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    order = rng.permutation(2000)
    packed = [r.tobytes() for r in np.packbits(x, axis=1)]
    m = langid.solve([packed[i] for i in order], [f"l{i % 1000:04d}" for i in order])
    assert len(m.languages) == 1000 and sum(f.nbytes for f in m.factors) < 20e6
    folded = m.factors[0] @ m.factors[1]
    some = x[:20]
    plain = (some @ folded) / np.sqrt(some.sum(axis=1, keepdims=True))
    assert np.allclose(m.scores(some), plain, atol=1e-4)
