import random

import pytest
from pyspark.sql import functions as F

from depotlens.llm import language


def words(seed):
    """Words of an invented language of its own letters."""
    rng = random.Random(seed)
    letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 7)
    return ["".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(12)]


def say(lang, n, seed):
    return " ".join(random.Random(seed).choices(words(lang), k=n))


@pytest.fixture
def rows():
    """Two languages of many rows, nine of one each, and texts in one, two and three of them."""
    known = [(100 * k + i, say(k, 60, i), f"l{k:02d}") for k in range(11) for i in range(30 if k < 2 else 1)]
    mixed = [(5000 + k, " ".join(say(x, 90, k) for x in {k % 11, (k * 3) % 11, (k // 2) % 11}), None) for k in range(22)]
    return [*known, *mixed, (9000, None, None), (9001, "12 3", "l01")]


def test_every_label_is_learned(spark, rows, monkeypatch):
    """However few languages a table holds, each one is judged: as if one table held all."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = lambda: {r.doc_id: (r.lang_pred, [x.lang for x in r.langs], [round(x.share, 6) for x in r.langs]) for r in language.identify(df, df.select("text", "lang")).collect()}
    whole = seen()
    assert all(whole[i][0] == lang for i, _, lang in rows if lang and i < 5000) and len({x[0] for x in whole.values()}) == 12
    assert max(len(x[1]) for x in whole.values()) >= 3 and whole[9000] == whole[9001] == ("und", [], [])
    monkeypatch.setattr(language, "MOST", 4)
    assert [len(langs) for langs, _ in language.tables(df.filter("lang is not null").select("text", "lang"))] == [2, 4, 4, 1]
    assert seen() == whole


def test_the_pipeline_reads_every_label(spark, rows, monkeypatch):
    monkeypatch.setattr(language, "MOST", 8)
    rows = [r for r in rows if r[2] or r[0] >= 9000]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_row_number", F.lit(7))
    got = language.keep_identified(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(i for i, x, _ in rows if x and x != "12 3")
