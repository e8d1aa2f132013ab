import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sensorlab.llm import wavelet

from .conftest import ODD_TEXTS

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_shard_against_lists():
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 5000):
        x = (rng.integers(0, 40, n) * 3).astype(np.uint32)
        s = wavelet.TokenShard.load(wavelet.TokenShard.build(x, [7, None], np.array([n, 0])).to_bytes())
        assert s.ids == [7, None] and s.counts.tolist() == [n, 0]
        assert s.tokens().tolist() == x.tolist()
        at = rng.integers(0, max(n, 1), 50) if n else np.zeros(0, np.int64)
        assert s.access(at).tolist() == x[at].tolist()
        for token in (0, 9, 10, 117, 999):
            where = np.flatnonzero(x == token)
            ends = rng.integers(0, n + 1, 20)
            assert s.rank(token, ends).tolist() == [int((x[:e] == token).sum()) for e in ends]
            assert s.count(token) == len(where)
            assert s.occurrences(token).tolist() == where.tolist()


def encode_all(texts):
    raw = [x.encode() for x in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, at = wavelet.WordEncoder(FILE).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_stretches_as_whole_text(tokenizer):
    """Encoding stretch by stretch equals encoding the whole text."""
    rng = random.Random(1)
    letters = list("abcABCIK'sdlvre,.;<!  \n\t\r10９0é́̈̊̇̈İΣσς中٣!#\x1c\x85　​\u0338\U0001F600ǅ ﬁ한ᄀ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 8, 60]))) for _ in range(6000)]
    texts += ["".join(rng.choice("abcdßàéñöøÿüç") for _ in range(rng.choice([1, 4, 9]))) for _ in range(3000)]
    texts += [a + chr(m) + b for a in "AaIiKkZ<=>'" for m in [*range(0x300, 0x370), 0x3099, 0x20D0] for b in ("", "s,")]
    texts += [t or "" for t in ODD_TEXTS]
    for t, ids in zip(texts, encode_all(texts), strict=True):
        assert ids == tokenizer(t), repr(t)


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_with_equal_polynomials(tokenizer, n):
    """A Thue-Morse word and its mirror agree in every polynomial modulo 2^64 with an odd base."""
    texts = [thue_morse(n, *x) for x in ("ab", "ba", "te", "et")]
    assert encode_all(texts) == [tokenizer(t) for t in texts]


def test_equal_hashes_are_told_apart(tokenizer, monkeypatch):
    """All stretches in one hash group: the bytes decide."""
    monkeypatch.setattr(wavelet, "slice_hashes", lambda data, s, e: np.asarray(e - s, np.uint64) % np.uint64(2))
    texts = ["one two three four", "two one ones twos", "", "a b c a b d", "x" * 300 + " y " + "x" * 300]
    assert encode_all(texts) == [tokenizer(t) for t in texts]


def test_cache_generations(tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE_WORDS", 5)
    enc = wavelet.WordEncoder(FILE)
    for i in range(30):
        t = f"the w{i} and w{i % 3}, w{i // 2}"
        got = enc.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        assert got[0].tolist() == tokenizer(t)


def test_shards_round_trip(make, tokenizer, spark, monkeypatch):
    docs = [(i * 7 % 53 - 5, t, "x") for i, t in enumerate(ODD_TEXTS * 3)] + [(None, "no id", "x")]
    files = wavelet.write_shards(make(docs, "doc_id long, text string, start string"), FILE, end_id=2)
    got = wavelet.read_shards(spark, files).collect()
    assert len(got) == len(docs)
    got.sort(key=lambda r: r.start)
    at, order = 0, []
    for r in got:
        assert r.start == at
        at += r.n_tokens
        order.append(r.doc_id)
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    want = sorted((d is not None, d or 0, zlib.crc32(np.array([*tokenizer(t or ""), 2], "<u4").tobytes())) for d, t, _ in docs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(bytes(r.ids))) for r in got) == want
    ends = wavelet.occurrences(files, 2)
    assert ends.count() == sum(np.frombuffer(bytes(r.ids), "<u4").tolist().count(2) for r in got)


def test_many_files(make, spark, monkeypatch):
    """Files close at their size; offsets run on across files and tasks."""
    docs = make([(i, "some words here " * (i % 9)) for i in range(200)], "doc_id long, text string")
    files = wavelet.write_shards(docs, FILE, end_id=2)
    got = sorted(wavelet.read_shards(spark, files).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in got] == [3 * (i % 9) + 1 for i in range(200)]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()


def test_empty_table(make, spark):
    files = wavelet.write_shards(make([], "doc_id long, text string"), FILE, end_id=2)
    assert wavelet.read_shards(spark, files).count() == 0


def test_special_tokens_in_texts_as_the_library_by_default():
    """Their strings stand for their ids, found in the text as it stands."""
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "a", "don", "'t", "B", " ", "\u0338", "0", "é", "<|", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 7]))) for _ in range(6000)]
    texts += ["hello <|endoftext|> world", *[t or "" for t in ODD_TEXTS]]
    raw = [x.encode() for x in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, at = wavelet.WordEncoder(FILE, added_tokens=True).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    library = Tokenizer.from_file(FILE)
    assert at[0] == 0 and at[-1] == len(ids)
    for t, a, b in zip(texts, at, at[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_query_gives_the_library_s_ids(make, spark, tmp_path):
    from sensorlab.llm.queries import QUERIES
    texts = ["hello <|endoftext|> world", "plain", "<|startoftext|><|ENDOFTEXT|>", None]
    make(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library, start = Tokenizer.from_file(FILE), 0
    for r in sorted(QUERIES["op8_wavelet"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
