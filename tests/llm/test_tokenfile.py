import random
import zlib

import numpy as np
import pytest
from edge import documents, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depotlens.llm import registry, tokenfile


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenfile.default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_units_have_the_ids_of_whole_texts(tokenizer):
    """All of the basic plane beside letters, blanks and signs, and mixtures of what the splitter looks at."""
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1F300, 0x1F400))]
    texts = ["".join(f"a{c}b {c} {c}{c}  {c}\n{c}b'{c}s 1{c}" for c in chars[i : i + 60]) for i in range(0, len(chars), 60)]
    rng = random.Random(3)
    pool = [*" \n\t\xa0　' a\xe9.,1中\x1cS!<|>", "<|endoftext|>", "'ll", "  ", "wordy " * 9, "x" * 60]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    encoder = tokenfile.UnitIds(tokenfile.default_tokenizer())
    texts += ["".join(rng.choice("'abe\xe9\xaa\xb5\xba\u01c5\u0142 .,'st") for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    want = [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1]) == want[::-1]  # from what is remembered


def test_a_full_memory_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE", 50)
    encoder = tokenfile.UnitIds(tokenfile.default_tokenizer())
    texts = [t or "" for _, t in documents()]
    for i in range(0, len(texts), 5):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts[i : i + 5])] == [ids_of(tokenizer, t)[:-1] for t in texts[i : i + 5]]


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10**12, n, replace=False) - 10**6
    table = tokenfile.PerfectHash.build(keys)
    assert sorted(table.places(keys).tolist()) == list(range(n))
    assert len(table.words) * 64 <= 6 * n + 64 * 20
    shard_index = tokenfile.pack_index(keys, [None] * n, np.ones(n, np.int64))
    assert len(shard_index) < 40 * n + 2000
    with pytest.raises(ValueError):
        tokenfile.PerfectHash.build(np.array([5, 5]))


def store(spark, tmp_path, rows):
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(frame(spark, rows) if isinstance(rows, list) else rows, path)
    return path


def test_round_trip_of_every_row(spark, tmp_path, tokenizer):
    """Missing and repeated ids, repeated rows, empty, null and long texts, id 0 inside texts, special strings."""
    rows = [*documents(), (None, "no id!"), (None, None), (7, "!!!!"), (7, "twice <|endoftext|>  x"), (-3, "first"), (2000, "word " * 30000)]
    every = [*rows, rows[0]]
    path = store(spark, tmp_path, spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in every], "doc_id long, text string, key string, at int, value int, _row_number int"))
    got = tokenfile.read_tokens(spark, path).orderBy("key").collect()
    want = {}
    for i, t in every:
        want.setdefault(i, []).append(ids_of(tokenizer, t))
    start = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens) == (start, len(ids))
        want[r.doc_id].remove(ids)
        start += len(ids)
    assert not any(want.values())
    order = [-(10**9) if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    m = tokenfile.read_manifest(spark, path).agg(F.sum("tokens"), F.sum("docs")).first()
    assert tuple(m) == (start, len(every))


def test_the_shards_are_the_gapless_ids(spark, tmp_path, tokenizer):
    rows = [(i, f"text {i} !") for i in range(40)]
    path = store(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"))
    raw = b""
    for r in tokenfile.read_manifest(spark, path).orderBy("shard").collect():
        with open(r.path.removeprefix("file:"), "rb") as f:
            raw += f.read(r.width * r.tokens)
    assert np.frombuffer(raw, "<u2").tolist() == [i for _, t in rows for i in ids_of(tokenizer, t)]


def test_keyed_access(spark, tmp_path, tokenizer):
    rows = [(3 * i, f"text {i} !") for i in range(300)] + [(10_000, None)]
    path = store(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"))
    reader = tokenfile.Reader(spark, path)
    for i, t in (*rows[::40], rows[-1]):
        assert reader.get(i).tolist() == ids_of(tokenizer, t)
    assert [reader.get(k) for k in (-1, 1, 899, 9_999, 10_001)] == [None] * 5
    wanted = spark.createDataFrame([(k,) for k in (0, 3, 3, 4, 300, 10_000, 99_999, None)], "wanted long")
    found = {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfile.lookup(wanted, path, "wanted").collect()}
    assert found == {i: ids_of(tokenizer, t) for i, t in rows if i in (0, 3, 300, 10_000)}


def test_no_documents(spark, tmp_path):
    path = store(spark, tmp_path, [])
    assert tokenfile.read_tokens(spark, path).collect() == [] and tokenfile.Reader(spark, path).get(1) is None


def test_query_reads_every_document(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in registry.queries()["op13_token_files"](spark, sf).collect()}
    start = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(ids_of(tokenizer, d.text), "<u4")
        assert tuple(got[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) > 100
