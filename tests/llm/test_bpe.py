import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from sensorlab.llm import bpe

from .conftest import ODD_TEXTS

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_local(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    coded, begin = bpe.Encoder(bpe.vocabulary(RANKS)).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    at = np.searchsorted(begin, off)
    return [np.frombuffer(b"".join(coded[a:b]), "<u4").tolist() for a, b in zip(at, at[1:], strict=False)]


def test_random_texts_as_tiktoken(reference):
    rng = random.Random(3)
    letters = list("abtsrevlmd'' ''  \n\t1２é́ 中٣!#\x1c\x85　​\U0001F600-ǅ٤²Ⅷ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 40, 300]))) for _ in range(5000)]
    texts += ["=" * 500, " " * 300, "'" * 70, "ab" * 3000]
    assert encode_local(texts) == [reference.encode_ordinary(t) for t in texts]


def test_code_point_classes(reference):
    """Every code point splits as the pattern's engine splits it."""
    ranks = {bytes([b]): b for b in range(256)}
    for i, c in enumerate(b"x1!"):
        ranks |= {bytes([c, b]): 256 * (i + 1) + b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    classes = bpe._classes()
    for start, cls in (("x", bpe.LETTER), ("1", bpe.NUMBER), ("!", bpe.OTHER)):
        for cp in [*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000, 3)]:
            if chr(cp) not in "'":
                joined = len(probe.encode_ordinary(start + chr(cp))) == len(chr(cp).encode())
                assert joined == (classes[cp] == cls), hex(cp)


def test_table_round_trip(make, reference):
    df = make([(i, t, "kept") for i, t in enumerate([*ODD_TEXTS, *ODD_TEXTS])], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert len(out) == 2 * len(ODD_TEXTS)
    for r in out:
        raw = (r.text or "").encode()
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert ids.tolist() == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == raw and r.n_tokens == len(ids)
        begin = np.frombuffer(bytes(r.offsets), "<u4")
        size = [len(reference.decode_single_token_bytes(i)) for i in ids.tolist()]
        assert begin.tolist() == np.concatenate([[0], np.cumsum(size)])[:-1].astype(int).tolist()


def test_query_on_table(spark, reference):
    from sensorlab.llm.queries import QUERIES
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_empty_table(make):
    df = make([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, RANKS), RANKS).where(F.col("n_tokens") > 0).count() == 0
