import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.elias_fano import EliasFano
from tessera.llm.token_files import fetch, op11_token_files, read_documents, write_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens string, shard string"


def test_elias_fano():
    r = random.Random(3)
    cases = [[], [0], [5, 5, 5], [2**64 - 1], [0, 2**64 - 1], list(range(1000)), [7] * 600 + [2**40] * 600]
    cases += [sorted(r.randrange(2 ** r.randrange(1, 64)) for _ in range(r.randrange(1, 1500))) for _ in range(40)]
    for numbers in cases:
        coded = EliasFano.from_bytes(EliasFano.encode(np.array(numbers, np.uint64)).to_bytes())
        assert coded.all().tolist() == numbers and len(coded) == len(numbers)
        assert [coded[i] for i in range(len(numbers))] == numbers


def test_elias_fano_space():
    numbers = np.sort(np.random.default_rng(1).integers(0, 10**9, 100_000).astype(np.uint64))
    assert len(EliasFano.encode(numbers).to_bytes()) * 8 / 100_000 < 17  # log2(10**9 / 10**5) = 13.3, and 2 for the high parts, 0.13 for samples


def rows():
    r = random.Random(5)
    out = [(10 * i, " ".join(r.choice(["alpha", "Beta,", "x1", "été", "<|endoftext|>"]) for _ in range(r.randrange(90))), "a", None, None) for i in range(-30, 60)]
    out += [(7, "one", None, None, None)] * 3 + [(7, "other two", None, None, None), (None, "no id", None, None, None), (None, None, None, None, None), (8, "", None, None, None), (9, None, None, None, None)]
    return out + [(55, "word " * 5000, None, None, None), (2**62, "far", None, None, None), (-(2**62), "near", None, None, None)]


def expected(data):
    t = Tokenizer.from_file(PATH)
    coded = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x, *_ in data]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    coded.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), crc(x[1])))
    out, at = [], 0
    for d, ids in coded:
        out.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    return out, coded


def test_files_read_back(spark, tmp_path):
    """Short segments: documents of several chunks, several shards, repeated and null ids, clashing columns."""
    data = rows()
    want, coded = expected(data)
    write_ids(spark.createDataFrame(data, SCHEMA).repartition(5), str(tmp_path), PATH, segment_ids=300, shard_bytes=4000)
    got = read_documents(spark, str(tmp_path), with_ids=True).collect()
    assert sorted((tuple(x)[:4] for x in got), key=lambda x: x[1]) == want
    assert {x.start: np.frombuffer(x.ids, "<u2").tolist() for x in got} == {w[1]: ids for w, (_, ids) in zip(want, coded, strict=True)}
    segments = spark.read.parquet(f"{tmp_path}/segments")
    assert segments.select("shard").distinct().count() > 3 and segments.where("chunks > 1").count() > 10
    for doc in (7, 50, 55, 2**62, -(2**62), -300):
        found = {}
        for x in sorted(fetch(spark, str(tmp_path), doc).collect(), key=lambda x: (x.shard, x.segment, x.place, x.chunk)):
            found.setdefault((x.shard, x.segment, x.place), []).extend(x.ids)
        assert list(found.values()) == [ids for d, ids in coded if d == doc]
    assert fetch(spark, str(tmp_path), 56).count() == 0


def test_empty(spark, tmp_path):
    write_ids(spark.createDataFrame([], SCHEMA), str(tmp_path), PATH)
    assert read_documents(spark, str(tmp_path)).collect() == []


def test_query(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_token_files(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected(data)[0]
