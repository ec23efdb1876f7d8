import zlib

import numpy as np
from tokenizers import Tokenizer

from servista.llm import binary, common
from servista.llm.tokens import Encoder, tokenizer_path

TEXTS = ["it's  \n\n x <|endoftext|> we'LL", "", "  ", "é́ 日本 ²³ 12½ İ", "a", "Plain words, again words.\n\tAnd more 123 ", "x" * 5000, " nbsp soft­hyphen"]


def test_cached_ids_equal_the_librarys():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = tokenizer_path(name)
        ids, counts = Encoder(path).encode(TEXTS)
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        want = [e.ids for e in tok.encode_batch(TEXTS, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_segment_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 127, 128, 129, 70_000):
        for high in (1, 2, 50_257, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            if n > 200:
                ids[::97] = 2**32 - 1
            data = memoryview(binary.encode_segment(ids))
            at = 0

            def read(k):
                nonlocal at
                at += k
                return bytes(data[at - k : at])

            assert (binary.decode_segment(read) == ids).all() and at == len(data)


def test_files_hold_whole_documents(spark, tmp_path):
    rows = [(5, TEXTS[0], "x"), (3, None, "y"), (3, "twice", "z"), (None, "no id", None), (9, TEXTS[5] * 300, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = tokenizer_path("byte_bpe_50k.json")
    got = binary.token_files(spark, docs, path, 2, folder=f"file://{tmp_path}/out").orderBy("start").collect()
    tok = Tokenizer.from_file(path)
    start = 0
    assert [r.doc_id for r in got] == [None, 3, 3, 5, 9]
    for r, text in zip(got, ["no id", "", "twice", TEXTS[0], TEXTS[5] * 300], strict=True):
        tok.encode_special_tokens = True
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_many_shards_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(i * 7 % 100, f"text number {i} " * (i + 1)) for i in range(100)], "doc_id long, text string")
    shards = binary.write_shards(docs, f"file://{tmp_path}/many", tokenizer_path("byte_bpe_50k.json"), 2, shard_bytes=common.input_bytes(docs) // 7)
    assert len(shards) > 3
    got = binary.read_documents(spark, shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(100))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert binary.token_files(spark, docs.limit(0), tokenizer_path("byte_bpe_50k.json"), 2).count() == 0
