import hashlib

import numpy as np
import pyarrow as pa
import pytest
from edge import FOLD, benchmark_hits, documents, frame, near_components, repeats, unruly
from oracle import compare, connect
from pyspark.sql import functions as F

from depotlens.llm import automaton, chat, contamination, exact, html, jaccard, language, packing, registry, shingles, suffixes, toxicity
from depotlens.llm import repeats as repeats_module
from depotlens.llm.common import components
from depotlens.llm.repeats import removed_units, repeat_windows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])


def test_there_is_one_query_for_each_operator():
    assert [int(k[2:].split("_")[0]) for k in registry.queries()] == list(range(1, 14))


# exact dedup


@pytest.mark.parametrize("block,mask", [(4096, -1), (7, -1), (16, 7)])  # the last makes most fingerprints collide
def test_exact_groups(spark, block, mask):
    rows = documents()
    got = {r.doc_id: r for r in exact.exact_groups(frame(spark), block=block, fingerprint=lambda b: F.xxhash64(b).bitwiseAND(F.lit(mask))).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_rows_without_ids_and_with_repeated_ones(spark):
    """Every row is read, and each stage keeps one row of what it takes for the same."""
    rows = [(1, "Aa b c d e f g"), (1, "aa b c d e f g"), (1, "other text here"), (None, "aa b c d e f g"), (None, None), (5, ""), (7, "12 3"), (None, "lonely text of no id"), (9, "one two three four five six seven"), (None, "one two three four five six seven")]
    df = spark.createDataFrame([(i, x, None, "x", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    got = order((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df).collect())
    assert got == order([(1, 1, 3, True), (1, 1, 3, True), (1, 1, 1, True), (None, 1, 3, None), (None, 5, 2, None), (5, 5, 2, True), (7, 7, 1, True), (9, 9, 2, True), (None, 9, 2, None), (None, None, 1, None)])
    left = lambda d: order((r.doc_id, (r.text or "").lower()) for r in d.select(*df.columns).collect())
    assert left(exact.drop_exact(df)) == order([(1, "aa b c d e f g"), (1, "other text here"), (5, ""), (7, "12 3"), (9, rows[8][1]), (None, rows[7][1])])
    assert left(jaccard.drop_near(df)) == order([(None, rows[3][1]), (1, "other text here"), (None, ""), (5, ""), (7, "12 3"), (None, rows[8][1]), (None, rows[7][1])])
    items = spark.createDataFrame([(1, rows[7][1])], "item_id long, text string")
    assert left(contamination.drop_contaminated(df, items)) == order((i, (x or "").lower()) for i, x in rows if i or x != rows[7][1])
    assert left(language.keep_identified(df)) == order((i, x.lower()) for i, x in rows if x and x != "12 3")  # also where no lang is known


def test_every_row_is_a_document(spark):
    """Ids that are missing or repeat, and repeated rows, through every operator on documents: no row is lost or merged."""
    rows = unruly()
    df = spark.createDataFrame([(i, t, "en", 7, 8) for i, t in rows], "doc_id long, text string, lang string, _row_number int, id int")
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(13)))], "item_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    ids = sorted((str(i) for i, _ in rows))
    seen = lambda out: sorted(str(r.doc_id) for r in out.collect())
    hit = contamination.contamination(df, items)
    assert seen(hit) == ids and hit.filter("n_hit = 13").count() == 4
    words, chars = automaton.dedup_words(df), suffixes.dedup_bytes(df)
    assert seen(words) == seen(chars) == ids
    assert sorted(r.n_removed for r in words.filter("n_words = 40").collect()) == [0, 40, 40, 40]
    assert [r.n_removed for r in words.filter("n_words = 40 AND doc_id IS NULL").orderBy("n_removed").collect()] == [0, 40]
    groups = exact.exact_groups(df)
    assert seen(groups) == ids and sorted(r.group_size for r in groups.collect()) == sorted([4] * 4 + [4] * 4 + [3] * 3 + [1, 1])
    near = jaccard.near_groups(df)
    assert seen(near) == ids and {r.component_id for r in near.filter("n_shingles = 36").collect()} == {1}
    assert seen(toxicity.score_documents(df, labels)) == seen(language.identify_documents(df)) == ids
    packed = packing.pack(df)
    assert seen(packed.filter("start = 0")) == ids and packed.agg(F.sum("length")).first()[0] == packed.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    for stage in (exact.drop_exact(df), jaccard.drop_near(df), contamination.drop_contaminated(df, items), language.keep_identified(df)):
        assert stage.columns == df.columns and {r._row_number for r in stage.collect()} == {7}


def test_a_dirty_language_column(spark, monkeypatch):
    """More labels than a model holds: those of few rows are dirt, the others are learned."""
    monkeypatch.setattr(language, "MOST", 4)
    rows = [(f"the cat sat on the mat {i}", "en") for i in range(40)] + [(f"die katze sass auf der matte {i}", "de") for i in range(40)] + [(f"text {i}", f"dirt{i}") for i in range(9)]
    langs, p = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert langs == ["de", "en"] and len(p) == 2


# near duplicates


def test_near_groups(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(frame(spark)).collect()}
    assert got == near_components(documents())


def test_near_groups_around_a_large_one(spark):
    """Copies of one text with more and more changes: those that miss the threshold by little stay apart, and no link is lost."""
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(90)]
    rows = [(0, " ".join(base))]
    for i in range(1, 240):
        w = list(base)
        for k in rng.choice(90, i % 8, replace=False):
            w[k] = f"z{rng.integers(300)}"
        rows.append((i, " ".join(w[: 90 - i % 5])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = near_components(rows)
    assert got == want and 20 < len({c for _, c in want.values()}) < 230


def test_signatures_never_rule_out_a_link(spark):
    rng = np.random.default_rng(4)
    sets = [set(rng.integers(0, 400, rng.integers(1, 300)).tolist()) for _ in range(60)]
    sets += [s ^ set(rng.integers(0, 400, 20).tolist()) for s in sets]
    odd = lambda s: np.packbits((np.bincount([x * 7919 % jaccard.SIGNATURE for x in s], minlength=jaccard.SIGNATURE) & 1).astype(np.uint8)).view(np.int64).tolist()
    df = spark.createDataFrame([(i, len(s), odd(s)) for i, s in enumerate(sets)], "u long, nu long, bu array<long>")
    other = df.toDF("v", "nv", "bv")
    kept = {(r.u, r.v) for r in df.join(other, F.col("u") < F.col("v")).filter(jaccard.may_link("nu", "bu", "nv", "bv", 75)).select("u", "v").collect()}
    links = {(i, k) for i in range(120) for k in range(i + 1, 120) if 100 * len(sets[i] & sets[k]) >= 75 * len(sets[i] | sets[k])}
    assert links and links <= kept and len(kept) < 120 * 119 // 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 99), (7, 7)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {99: 99, 100: 99, 101: 99}


# substring dedup


@pytest.mark.parametrize("limits", [{}, {"heavy": 5, "shard_bytes": 500}])
def test_words_that_repeat(spark, limits):
    got = {r.doc_id: r for r in automaton.dedup_words(frame(spark), **limits).collect()}
    want = repeats(documents(), lambda t: (t or "").encode().split(), 20)
    assert set(got) == set(want) and any(any(g) for _, g in want.values())
    for i, (u, gone) in want.items():
        left = b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(u), sum(gone), hashlib.sha256(left).hexdigest()), i


@pytest.mark.parametrize("limits", [{}, {"heavy": 50, "shard_bytes": 900}])
def test_bytes_that_repeat(spark, limits):
    got = {r.doc_id: r for r in suffixes.dedup_bytes(frame(spark), **limits).collect()}
    for i, (u, gone) in repeats(documents(), lambda t: (t or "").encode(), 100).items():
        left = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(u), sum(gone), spans, hashlib.sha256(left).hexdigest()), i


def test_a_passage_in_ever_new_surroundings_fills_no_index(spark, tmp_path):
    """The edges of a passage that all texts hold differ in each text; no shard gets them all."""
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = word(300)
    rows = [(i, word(150) + passage + word(150)) for i in range(300)]
    most = 20_000

    def index(regions):
        (tmp_path / str(hash(tuple(regions)))).write_text(str(sum(map(len, regions))))
        return suffixes.new_windows(regions, 100)

    docs = spark.createDataFrame(rows, "id long, v0 string")
    args = (lambda t: suffixes._BYTE[np.frombuffer(t, np.uint8)], lambda t: lambda a, b: t[a:b], index, 100, 32)
    got = repeat_windows(docs, *args, shard_bytes=2000, heavy=5000).collect()
    spans = lambda rows: (np.array([x.a for x in rows or []], int), np.array([x.c for x in rows or []], int))
    gone = {r.id: int(removed_units(600, 100, spans(r.sent), spans(r.kept)).sum()) for r in got}
    want = {i: sum(g) for i, (_, g) in repeats(rows, lambda t: t.encode(), 100).items()}
    assert {i: gone.get(i, 0) for i in want} == want and sum(want.values()) >= 299 * 300
    assert max([0, *(int(f.read_text()) for f in tmp_path.iterdir())]) < most


def test_suffix_array_is_the_sorted_suffixes():
    rng = np.random.default_rng(0)
    for _ in range(100):
        t = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(1, 60)), 0).astype(np.int16)
        assert suffixes.suffix_array(t, 1000).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("length", [3, 8, 11, 100])
def test_windows_of_a_shard(length):
    """Against plain sets: periods, long copies with one changed byte, zero bytes, regions of one window."""
    rng = np.random.default_rng(length)
    say = lambda n, most=4: bytes(rng.integers(97, 97 + most, n).astype(np.uint8))
    long = say(400)
    regions = [say(length), long, long[:150] + b"z" + long[151:], long[7:], b"ab" * 200, b"ab" * 170, b"a" * 300, bytes(250), bytes(length), long[:120] + bytes(9) + long[120:], say(600, 1), b"\xff" * 130]
    regions = [r for r in regions if len(r) >= length]
    seen, want = set(), []
    for r in regions:
        want.append([])
        for k in range(len(r) - length + 1):
            want[-1].append(r[k : k + length] not in seen)
            seen.add(r[k : k + length])
    assert [x.tolist() for x in suffixes.new_windows(regions, length)] == want


def test_a_shard_of_many_regions_is_one_table(monkeypatch):
    made, table = [], repeats_module.pd.DataFrame
    regions = table({"id": [k % 250 for k in range(500)], "start": [k // 250 * 9 for k in range(500)], "units": [b"%05d" % k for k in range(500)]}).astype({"start": "int32"})
    monkeypatch.setattr(repeats_module.pd, "DataFrame", lambda *a: made.append(1) or table(*a))
    news = lambda units: [np.array([[1, 1, 0, 1], [0, 0, 0], [1], [0, 1, 1]][int(u) % 4], bool) for u in units]
    got = repeats_module._shard(news)(regions)
    runs = ([(0, 2), (3, 1)], [], [(0, 1)], [(1, 2)])
    want = [(i, s + a, c) for i, s, u in sorted(zip(regions["id"], regions["start"], regions["units"])) for a, c in runs[int(u) % 4]]
    assert list(zip(got["id"].tolist(), got["a"].tolist(), got["c"].tolist())) == want and len(made) == 1
    assert repeats_module._shard(lambda units: [])(regions[:0]).empty


def test_removed_units():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, length = int(rng.integers(10, 60)), int(rng.integers(1, 10))
        at = np.flatnonzero(rng.random(n - length + 1) < 0.3)
        sent, new = (at, np.ones(len(at), int)), at[rng.random(len(at)) < 0.5]
        want = [any(x <= i < x + length for x in set(at) - set(new)) for i in range(n)]
        assert removed_units(n, length, sent, (new, np.ones(len(new), int))).tolist() == want


# decontamination


@pytest.mark.parametrize("bits", [28, 9])  # a filter of 512 bits lets most tokens through
def test_contamination(spark, bits):
    rows = documents()
    text = rows[1][1].split(" ")
    items = [(1, " ".join(text[3:40])), (2, "one TWO three"), (3, None), (4, "!!"), (5, "w1"), (10, " ".join(text[10:23])), (10, "é")]
    got = contamination.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), filter_bits=bits)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == benchmark_hits(rows, items)
    assert all(r.n_hit == sum(s.b - s.a for s in r.spans) and all(x.b < y.a for x, y in zip(r.spans, r.spans[1:])) for r in got.collect())


def test_contamination_by_shared_windows_and_without_rows(spark):
    """A window that many items and many documents share, items of one window in a third of all rows, and empty tables."""
    w = [f"q{k}" for k in range(30)]
    items = [(k, " ".join(w[:20])) for k in range(40)] + [(99, " ".join(w[10:30])), (None, " ".join(w)), (7, "")]
    rows = [(k, " ".join(w[k % 7 :] + [f"own{k}"] * (k % 50))) for k in range(200)] + [(500, "q0 " * 5000)]
    rows, items = [(i, x) for i, x in rows], [(i, x) for i, x in items]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination.contamination(frame(spark, rows), table).collect()}
    assert got == benchmark_hits(rows, [x for x in items if x[0] is not None])
    none = contamination.contamination(frame(spark, rows[:3]), table.limit(0)).collect()
    assert [(r.n_hit, r.n_items, list(r.items), r.contaminated) for r in none] == [(0, 0, [], False)] * 3
    assert contamination.contamination(frame(spark, []), table).isEmpty()


def test_contamination_reads_each_text_once(spark):
    """A window at each distance from a text's start and end, windows one word short, and each text goes through Python once."""
    w = [f"q{k}" for k in range(16)]
    items = [(1, " ".join(w[:13])), (2, " ".join(w))]
    rows = [(k, " ".join([f"a{i}" for i in range(k % 30)] + w[: 12 + k % 5] + [f"b{i}" for i in range(k // 30)])) for k in range(300)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", seen("text"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination.contamination(docs, table).collect()}
    assert read.value == len(rows)
    assert got == benchmark_hits(rows, items)


def test_few_places_of_a_text_are_looked_at():
    words = [f"w{k}".encode() for k in range(100)]
    for width, step in ((1, 1), (2, 1), (3, 1), (3, 2), (3, 11), (3, 98), (3, 99)):
        all_places = contamination.codes(shingles.WordHashes().of(words), width)
        assert contamination.every(words, hashes := shingles.WordHashes(), width, step).tolist() == all_places[step - 1 :: step].tolist()
        assert step <= width or len(hashes) <= width * (100 // step)


# packing


def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [*documents(), (2000, "<|endoftext|> A. it's B.. <|ENDOFTEXT|>"), (2001, "word " * 5000)]
    ids = {i: [*e.ids, 1] for (i, _), e in zip(rows, Tokenizer.from_file(packing.default_tokenizer()).encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True)}
    got = packing.pack(frame(spark, rows), shard_bytes=4000).collect()
    text, seq = {}, {}
    for r in sorted(got, key=lambda r: r.start):
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == len(text.setdefault(r.doc_id, [])) and r.length == len(part) and r.doc_tokens == len(ids[r.doc_id])
        text[r.doc_id] += part
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert text == ids
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_chunks_have_the_ids_of_the_whole_text(monkeypatch):
    """Also where the cache is emptied between texts, and for letters that normalising splits or folds."""
    monkeypatch.setattr(packing, "CACHE", 12)
    rows = ["", " ", "<|endoftext|> Hi", "İstanbul ΣΑΣ ς", "İ> aİ.! KENDİ) İ", "שׁ x", "don't it's I'LL", "a.b, c., 3.14, ..", "été. ſtraße ǅ", "wo.$$$ x'y' it's, e\u0301!! a<|b|> l'\u00e9t\u00e9&&& 'tis don't.. co-op-", "\u00a0nbsp\u2003em", "𝒜bc 漢字 가각", "a\x1cb\x85c", "plain words, and plain words again."]
    chunks = packing.Chunks(packing.default_tokenizer())
    rows += ["seventeen-letters-and-more " * 3 + "sevent" + "e" * 60, "a\x00 a \x00a ab\x00", "x" * 16 + " " + "x" * 17]
    want = [[*chunks.tokenizer.encode(text, add_special_tokens=False).ids, 1] for text in rows]
    assert [x.tolist() for text in rows * 2 for x in chunks.encode(pa.array([text]))] == want * 2
    assert [x.tolist() for x in chunks.encode(pa.array([None, *rows, *rows, ""]))] == [[1], *want, *want, [1]]


def test_chunks_of_any_letters_and_signs():
    """Random strings of letters, marks, signs, digits, blanks and special tokens against the tokenizer on the whole text."""
    rng = np.random.default_rng(11)
    signs = [*"abcXYZ'sdtrelv<|>!,.-_#$%&()0123 \t\n", "İ", "é", "É", "e\u0301", "\u0307", "ß", "ſ", "ﬁ", "ǅ", "K", "ª", "²", "’", "\u00a0", "\u200b", "ʰ", "日本", "한", "я", "<|startoftext|>", "<|endoftext|>", "don't", "I'LL"]
    rows = ["".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(0, 25))) for _ in range(8000)]
    chunks = packing.Chunks(packing.default_tokenizer())
    want = [[*e.ids, 1] for e in chunks.tokenizer.encode_batch(rows, add_special_tokens=False)]
    assert [x.tolist() for x in chunks.encode(pa.array(rows))] == want


def test_words_of_a_column():
    rows = [None, "", "a", "b c", "x" * 2_100_000 + " y", "d e f", "é ü", "ab", "cd ef", " g ", "A B", None]
    for column in (pa.array(rows), pa.array(["zz", *rows, "q"]).slice(1, len(rows))):
        numbers, ends = shingles.column_word_numbers(column)
        assert [numbers[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [shingles.word_numbers(r and r.encode()).tolist() for r in rows]


def test_the_rarest_shared_terms():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 30, n) for n in (5, 0, 1, 9, 0, 3)]
    df = rng.integers(0, 4, 30)
    want = [(*sorted({(df[t], t) for t in d if df[t] > 1})[:2], (0, -1), (0, -1))[:2] for d in docs]
    t1, t2 = packing.Deal(df, 10).keys(np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    assert list(zip(t1.tolist(), t2.tolist(), strict=True)) == [(a[1], b[1]) for a, b in want]


def test_neighbours_follow_their_seed():
    docs = [np.array(x) for x in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5])]
    index = packing.Bm25(docs, np.ones(16), 3.0)
    assert packing.arrange([3, 3, 3, 3], index, 6) == [0, 2, 1, 3]


def test_the_index_has_no_caps():
    """Nearest first by all terms of the seed, for as many documents as fill its window."""
    seed, rest = np.arange(60), [np.arange(60 - k % 50) for k in range(100)]
    got = packing.arrange([1] * 101, packing.Bm25([seed, *rest], np.ones(64), 40.0), 101)
    assert got == [0, *(1 + k for k in sorted(range(100), key=lambda k: (-len(rest[k]) / (1 + packing.K1 * (1 - packing.B + packing.B * len(rest[k]) / 40.0)), k)))]


@pytest.mark.parametrize("pairs", [200_000, 0])  # the table of heavy pairs broadcast, and joined by a shuffle
def test_a_heavy_pair_of_terms_fills_its_own_share_of_shards(spark, monkeypatch, pairs):
    monkeypatch.setattr(packing, "PAIRS", pairs)
    rows = [(i, 1, 2, 50) for i in range(400)] + [(400 + i, 1, 5 + i % 90, 50) for i in range(600)] + [(1000 + i, 7 + i % 3, -1, 10) for i in range(9)]
    got = packing.Deal(np.ones(16, np.int64), 1000).plan(spark.createDataFrame(rows, "id long, t1 int, t2 int, size long")).collect()
    assert len(got) == len(rows)
    load, at = {}, {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        at.setdefault((r.t1, r.t2), set()).add(r.shard)
    assert max(load.values()) <= 5000 and 15 <= len(at[1, 2]) <= 20
    assert all(len(x) == 1 for k, x in at.items() if k != (1, 2)) and not at[7, -1] & at[1, 2]


def test_neighbours_meet_in_one_shard(spark):
    """Whatever the number of shards; a term that many documents share is split to bounded shards."""
    rows = [(i, f"rare{i // 2}x " + " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(40))) for i in range(300)]
    rows += [(1000 + i, "one passage that many texts hold as it is " * 5) for i in range(100)]
    shards, size = {}, {}
    for r in packing.pack(frame(spark, rows), shard_bytes=4000).collect():
        shards[r.doc_id] = r.sequence_id >> 32
    for i, text in rows:
        size[shards[i]] = size.get(shards[i], 0) + len(text)
    assert len(size) > 10 and max(size.values()) < 3 * 4000
    assert sum(shards[i] == shards[i + 1] for i in range(0, 300, 2)) >= 145


# language and toxicity: held-out accuracy


def test_language_on_held_out_rows(spark):
    got = registry.queries()["op10_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_language_mixture_and_edges(spark):
    learn = spark.createDataFrame([("abc abd " * 50, "aa"), ("xyz xyw " * 50, "bb"), ("q", None)], "text string, lang string")
    docs = spark.createDataFrame([(1, "abc abd abc xyz xyw xyz xyz " * 20), (2, None), (3, "12 !"), (4, "abd")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(docs, learn).collect()}
    assert {x.lang for x in got[1].langs} == {"aa", "bb"} and got[1].lang_pred == "bb"
    assert (got[2].lang_pred, got[3].lang_pred, got[4].lang_pred) == ("und", "und", "aa") and got[2].score == 0


def test_mixtures_are_not_rejected(spark):
    """A text in three languages, none with half of it, stays in the pipeline."""
    say = {"aa": "abc abd ", "bb": "xyz xyw ", "cc": "mno mnp "}
    rows = [(i, say[k] * 50, k, "s") for i, k in enumerate(list(say) * 8)] + [(100, say["aa"] * 20 + say["bb"] * 18 + say["cc"] * 16, None, "s"), (101, "12 3", "aa", "s")]
    got = language.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(r.doc_id for r in got) == [*range(24), 100] and got[0].source == "s"


def test_toxicity_learns_and_restores(spark):
    base = [f"the plain words of text number {i} go on and on in the plain way of words" for i in range(300)]
    rows = [(i, t + (" you idiot moron" if i % 3 == 0 else ""), int(i % 3 == 0)) for i, t in enumerate(base)]
    learn = spark.createDataFrame(rows, "id long, text string, toxic int")
    docs = spark.createDataFrame([(1, "plain words you 1d10t"), (2, "plain words"), (3, None), (4, "you i d i o t"), (5, "m0r0n"), (6, "idiooooot")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, learn).collect()}
    assert min(got[1], got[4], got[5], got[6]) >= 0.5 > max(got[2], got[3])
    none = {r.score for r in toxicity.toxicity(docs, learn.filter("toxic = 0")).collect()}
    assert none == {0.0}


def test_long_stretches_are_restored():
    """Spaced-out messages, joined words, long runs and texts without blanks, whatever their length."""
    plain = ["you are an idiot and a moron too", "the plain words go on and on in the way of words"] * 50
    channel = toxicity.Channel(sum(np.bincount(toxicity.class_trigrams(t), minlength=1 << toxicity.MODEL_BITS) for t in plain))
    assert "idiot" in channel.restore("y o u a r e a n i d i o t a n d a m o r o n t o o " * 40).split()
    assert "moron" in channel.restore("you.are.a.m0r0n.and.an.1d10t.too.and.so.on").split()
    assert channel.restore("idi" + "o" * 5000 + "t") == "idiot"
    assert "idiot" in channel.restore("youareanandamorontoowordswordsthe1d10twords" * 30)


# html


def _say(n, word="word"):
    return " ".join([word] * n)


_LIST = "<ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li><li><a href=c>Contact</a></li></ul>"
_A, _B, _C = _say(90, "alpha"), _say(45, "beta"), _say(28, "gamma")
#: Pages without a marked article, and their main text, written by hand.
PLAIN_PAGES = [
    (f"{_LIST}<p>{_say(300)}</p><p>All rights reserved</p>", _say(300)),
    (f"<div>{_LIST}</div><h1>A small headline here</h1><div>{_A}</div><div>{_B}</div>{_LIST}", f"A small headline here\n{_A}\n{_B}"),
    (f"<h2>Heading of the text here below</h2><p>{_A}<p>{_C}<p>{_B}", f"Heading of the text here below\n{_A}\n{_C}\n{_B}"),
    (f"<table><tr><td>{_LIST}</td><td><p>{_A}</p><p>Short.</p><p>{_B}</p></td></tr></table>", f"{_A}\nShort.\n{_B}"),
    (f"<div class=banner>{_A}</div><div>{_B}</div><div>{_C}</div><div id=comments><p>{_A}</p></div>", f"{_B}\n{_C}"),
    (f"<nav>{_LIST}</nav><blockquote>{_B}</blockquote><pre>{_C}</pre><form>{_A}</form>", f"{_B}\n{_C}"),
    (f"<p>{_C} <a href=x>with one link</a> {_C}</p><p>{_A}</p><p><a href=1>more</a> <a href=2>and more of this</a></p>", f"{_C} with one link {_C}\n{_A}"),
    (f"{_LIST}{_LIST}{_LIST}", ""),
    (f"<p>{_A}</p><ol><li>{_C}</li><li>{_B}</li></ol>{_LIST}<p>Imprint</p>", f"{_A}\n{_C}\n{_B}"),
    (f"<div>{_A}<br>{_B}</div><script>{_C}</script><style>{_C}</style>", f"{_A} {_B}"),
    (f"{_LIST}<p>{_A}</p><p><a href=z>Read this as well</a></p><p>{_B}</p><p>{_C}</p>", f"{_A}\n{_B}\n{_C}"),
    (f"<p>{_A}</p><aside>{_B}</aside><p>{_C}</p><div role=contentinfo>{_C}</div>", f"{_A}\n{_C}"),
]


@pytest.mark.parametrize("page, want", PLAIN_PAGES)
def test_text_without_a_marked_article(page, want):
    assert html.main_text(page, html.default_tree()) == want
    assert html.main_text(f"<html><body class=page><div><div>{page}</div></div></body></html>", html.default_tree()) == want


def test_blocks_beside_an_article_are_not_its_text():
    page = f"<p>Subscribe today to our site</p><article><h1>Head</h1><p>{_A}</p><p>End.</p></article><p>Local weather sunny and warm</p><p>{_C}</p>"
    assert html.main_text(page, html.default_tree()) == f"Head\n{_A}\nEnd."
    teaser = f"<article><p>Read this first</p></article><p>{_A}</p><p>{_B}</p><p>{_C}</p>"  # a marked part that is not the page's text
    assert html.main_text(teaser, html.default_tree()) == f"Read this first\n{_A}\n{_B}\n{_C}"


def test_text_density_decides():
    """The tree splits on words and links, learns pages that it has not seen, and errs where these features are mixed up."""

    def splits(t):
        return set() if isinstance(t, float) else {html.FEATURES[t[0]]} | splits(t[2]) | splits(t[3])

    tree = html.default_tree()
    assert {"words", "links"} <= splits(tree) and splits(tree) & {"before", "after"}
    x, y = html.labelled()
    right = lambda rows: sum(html.decide(tree, r) == bool(v) for r, v in zip(rows.tolist(), y)) / len(y)
    assert right(x) > 0.98
    mixed = x.copy()
    mixed[:, :6] = np.random.default_rng(1).permutation(mixed[:, :6])
    assert right(mixed) < 0.9
    third = np.arange(len(y)) * 7 % len(y) % 3 == 0
    other = html.grow(x[~third], y[~third])
    assert np.mean([html.decide(other, r) == bool(v) for r, v in zip(x[third].tolist(), y[third])]) > 0.9


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=a>Home</a></nav>
<div class="cookie-notice">We use cookies here</div><article><h2>Head &amp; line</h2><p>One <b>two</b>
 three<br>four<script>var x = "</p>";</script><p>&lt;b&gt;<div class="ad">Buy</div><form>Mail <input></form><ul><li>a<li>b</ul>
<section id="comments"><p>I like it</p></section></article><aside>More</aside><footer>&copy;</footer><!-- <p>no</p> -->"""


def test_main_text():
    assert html.main_text(PAGE, html.default_tree()) == "Head & line\nOne two three four\n<b>\na\nb"
    assert html.main_text(None, html.default_tree()) == html.main_text("", html.default_tree()) == ""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", None), (2, None, "<p"), (3, "v", "x" * 100000)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars) for r in html.extract(pages).collect())
    assert [x[0] for x in got] == [1, 1, 2, 3] and got[0][1] == 0


# chat


def test_branches_are_ranked_and_read_back(spark):
    m = [("t", 1, None, "user", "q\\", 0.0), ("t", 2, 1, "assistant", "<|im_end|>", 1.0), ("t", 3, 1, "assistant", "[INST] b", 5.0), ("t", 4, 2, "a\nb", None, 0.0), ("t", 3, 1, "assistant", "[INST] b", 5.0), ("u", 9, 77, "assistant", "", None), (None, 1, None, "user", "x", 0.0)]
    df = spark.createDataFrame(m, "tree string, msg long, parent long, role string, text string, score double").withColumn("leaf", F.lit(1))
    out = chat.format_trees(df).select("tree", "leaf", "rank", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("own"), "formatted")
    got = {(r.tree, r.leaf): r for r in out.collect()}
    assert {k: r.rank for k, r in got.items()} == {("t", 3): 1, ("t", 4): 2, ("u", 9): 1}
    assert [tuple(t) for t in got["t", 4].turns] == [("user", "q\\"), ("assistant", "<|im_end|>"), ("a\nb", "")]
    assert (got["t", 3].own, got["t", 4].own, got["u", 9].own) == ("[INST] b", "<|im_end|>", "")
    assert chat.format_trees(df, 1).count() == 2


# empty tables


@pytest.mark.parametrize(
    "f",
    [
        exact.exact_groups,
        jaccard.near_groups,
        automaton.dedup_words,
        suffixes.dedup_bytes,
        packing.pack,
        lambda d: contamination.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
        lambda d: language.identify(d, d.select("text", F.lit("x").alias("lang"))),
        lambda d: toxicity.toxicity(d, d.select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("toxic"))),
        lambda d: html.extract(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))),
        lambda d: chat.format_trees(chat.linear_trees(d.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text"))),
    ],
)
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert f(spark.createDataFrame([(None, "no id"), (5, None)], "doc_id long, text string")).count() >= 1


# pipeline


def test_pipeline_against_plain_steps(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in documents() if r[0] < 1000]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, rows[4][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    last = {}
    for i, t in rows:
        last[t.translate(FOLD)] = max(i, last.get(t.translate(FOLD), i))
    left = [(i, t) for i, t in rows if last[t.translate(FOLD)] == i]
    near = near_components(left)
    left = [(i, t) for i, t in left if near[i][1] == i]
    dirty = benchmark_hits(left, items)
    want = {i for i, _ in left if not dirty[i][3]}
    assert len(want) < len(left) < len(rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
