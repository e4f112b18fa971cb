import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_counts
from tessera.llm.packing import first_fit_decreasing, pack
from tessera.llm.pretokens import WordTokens
from tessera.llm.token_counts import count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, block string, length string"
ODD = ["It's we're <|endoftext|>x <|startoftext|><|endoftext|> can't 12 ½ é é", "a\x0bb 　x ΑΣ ας İ K ǅ ß ﬁ 漢字 \U0001f600!!?? don'T '5  z y \x85", "", " ", "''s", "<|endoftext|", "a\tb\x00", None, "the " * 3000]


def rows():
    r = random.Random(2)
    out = [(i, t, None, "x") for i, t in enumerate(ODD)]
    return out + [(100 + i, " ".join(r.choice(["alpha", "Beta,", "x1", "été"]) for _ in range(r.randrange(900))), None, None) for i in range(60)] + [(3, "one id", None, None), (3, "one id", None, None), (None, "no id", None, None)]


def ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_split_equals_library():
    r, w = random.Random(4), WordTokens(PATH)
    letters = [chr(i) for i in range(0x180)] + list("‐–‘’†…€​ ́̈Σẞ漢")
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 12))) for _ in range(5000)] + [t or "" for t in ODD]
    whole = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert [[i for p in w.split(t) for i in w.ids(p)] for t in texts] == [e.ids for e in whole]


@pytest.mark.parametrize("block", [24 << 20, 500])
def test_counts(spark, block, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", block)
    data = rows()
    got = count_tokens(spark.createDataFrame(data, SCHEMA).repartition(3), PATH).collect()
    want = [(d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for d, t, *_ in data]
    assert sorted((tuple(x) for x in got), key=str) == sorted(want, key=str)


def test_first_fit_decreasing():
    r = random.Random(1)
    for _ in range(50):
        lengths = [r.randrange(1, 101) for _ in range(r.randrange(1, 60))]
        bins, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((b for b, used in enumerate(bins) if used + lengths[i] <= 100), len(bins))
            if b == len(bins):
                bins.append(0)
            want[i] = (b, bins[b])
            bins[b] += lengths[i]
        assert first_fit_decreasing(lengths, 100) == [want[i] for i in range(len(lengths))]


def test_pack(spark):
    data = rows()
    got = pack(spark.createDataFrame(data, SCHEMA).repartition(3), PATH, group_pieces=20).collect()
    want = []
    for d, t, *_ in data:
        a = np.array([*ids(t), 1], "<u4")
        want += [(d, s, min(2048, len(a) - s), zlib.crc32(a[s : s + 2048].tobytes()), len(a)) for s in range(0, len(a), 2048)]
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    used = {}
    for x in got:
        used.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(x[2] for x in want) / (2048 * len(used)) > 0.8


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert count_tokens(empty, PATH).collect() == [] and pack(empty, PATH).collect() == []
