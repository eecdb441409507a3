"""Language identification by multilingual mixture inference.

A language is a smoothed distribution of character trigrams, counted over all
training texts. A text is a mixture of languages. Its set begins with the likeliest one; then
the language by which the log-likelihood rises fastest is added, and expectation-
maximisation estimates the proportions anew, while the gain exceeds the penalty of a
further share.

Each language is judged by its own likelihoods and those of the set alone, so
it doesn't matter in which order languages come. A model is tables of at most
MOST languages: where there are more labels, one table after the other
offers its best language to every text, and none is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, ROW, as_they_were, bucket_counts, cut, drop_table, map_rows, named, numbered

BITS, ROUNDS, PENALTY, SMOOTH = 16, 12, 6.0, 0.5
#: Languages of one table, which the driver and each task hold at a time.
MOST = 256
UNKNOWN = "und"

_PLANE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which of the first 65,536 code points are letters."""
    if not _PLANE:
        _PLANE.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    return _PLANE[0]


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams of a lower-cased text in which every other character than a letter is a blank.

    Trigrams without a letter in the middle are left out, so blanks carry no weight.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        letter[high] = [chr(p).isalpha() for p in points[high].tolist()]
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.zeros(len(points) + 2, np.uint32)
    c[1:-1] = np.where(letter, points, 0)
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B)) * np.uint32(5) + c[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS))[letter].astype(np.int64)


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(text, lang) to the languages in name order and the probability of each trigram bucket by language.

    Where there are over MOST labels, only those of at least one in MOST rows: ``tables`` has the others too.
    """
    if many(labelled):
        rows, total = _sizes(labelled)
        labelled = labelled.join(F.broadcast(rows.filter(F.col("n") * MOST >= total).select("lang")), "lang", "left_semi")  # MOST at most
    return _counted(labelled)


def many(labelled: DataFrame) -> bool:
    """Whether there are more labels than one table holds."""
    return labelled.select("lang").distinct().limit(MOST + 1).count() > MOST


def _sizes(labelled: DataFrame) -> tuple[DataFrame, int]:
    return labelled.groupBy("lang").agg(F.count("*").alias("n")), labelled.count()


def tables(labelled: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """All languages, in tables as of ``train``: those of many rows first, then the others by name, each counted when it is asked for."""
    yield train(labelled)
    if not many(labelled):
        return
    rows, total = _sizes(labelled)
    rest = cut(rows.filter(F.col("n") * MOST < total).select("lang"))
    after = rest
    while names := [r.lang for r in after.orderBy("lang").limit(MOST).collect()]:
        yield _counted(labelled.filter(F.col("lang").isin(names)))
        after = rest.filter(F.col("lang") > names[-1])
    drop_table(rest)


def _counted(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    def features(b: pa.RecordBatch):
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(trigrams(text))
        for lang, parts in by.items():
            yield lang, np.concatenate(parts)

    counts = bucket_counts(labelled.select("text", "lang"), features, BITS)
    langs = sorted(k for k, v in counts.items() if v.any())
    if not langs:
        return [], np.zeros((0, 1 << BITS))
    p = np.array([counts[x] for x in langs], float) + SMOOTH
    return langs, p / p.sum(axis=1, keepdims=True)


def mixture(p: np.ndarray, c: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions of the rows of p (likelihoods of distinct grams) that best explain the counts c."""
    share = np.full(len(p), 1 / len(p))
    weight = c / c.sum()
    for _ in range(rounds):
        part = p * share[:, None]
        share = part @ (weight / part.sum(axis=0))
    return share


class Mix:
    """The set of a text: names, shares, and the likelihoods (rows) of the text's distinct grams, which occur c times."""

    def __init__(self, c: np.ndarray, names: list[str] = (), shares: np.ndarray = np.ones(0), rows: np.ndarray | None = None):
        self.c, self.names, self.shares = c, list(names), shares
        self.rows = np.zeros((0, len(c))) if rows is None else rows

    def offer(self, langs: list[str], likely: np.ndarray) -> tuple[float, str, np.ndarray] | None:
        """(pull, lang, row) of the best further language of a table; ties go to the first name."""
        if not self.names:
            pull = np.log(likely) @ self.c
        else:
            pull = likely @ (self.c / (self.shares @ self.rows))
            pull[[k for k, x in enumerate(langs) if x in self.names]] = -np.inf
        k = int(pull.argmax())
        if self.names and pull[k] <= self.c.sum():  # no share of it makes the text likelier
            return None
        return float(pull[k]), langs[k], likely[k]

    def take(self, lang: str, row: np.ndarray) -> bool:
        """Add a language if that gains more than its price."""
        rows = np.vstack([self.rows, row])
        shares = mixture(rows, self.c)
        if self.names:
            gain = self.c @ np.log(shares @ rows) - self.c @ np.log(self.shares @ self.rows)
            if gain <= PENALTY * np.log(max(2, self.c.sum())):
                return False
        self.names, self.shares, self.rows = [*self.names, lang], shares, rows
        return True

    def result(self) -> tuple[str, float, list[dict]]:
        """(lang_pred, score, langs)."""
        share = dict(sorted(zip(self.names, self.shares.tolist(), strict=True)))
        if not share:
            return UNKNOWN, 0.0, []
        best = max(share, key=share.get)
        return best, min(1.0, share[best]), [{"lang": k, "share": v} for k, v in share.items() if v]


def predict(text: str | None, langs: list[str], p: np.ndarray) -> tuple[str, float, list[dict]]:
    """(lang_pred, score, langs) of a text by a model of one table."""
    grams, c = np.unique(trigrams(text), return_counts=True)
    mix = Mix(c)
    if len(grams) and langs:
        likely = p[:, grams]
        while (best := mix.offer(langs, likely)) and mix.take(*best[1:]):
            pass
    return mix.result()


STATE = "id long, v0 string, names array<string>, shares array<double>, rows binary, pull double, lang string, row binary, over boolean"


def _mix(r: dict) -> tuple[np.ndarray, Mix]:
    grams, c = np.unique(trigrams(r["v0"]), return_counts=True)
    return grams, Mix(c, r["names"], np.array(r["shares"], float), np.frombuffer(r["rows"], float).reshape(-1, len(c)) if len(c) else None)


def by_tables(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """(id, lang_pred, score, langs) of (id, v0), table by table: what ``predict`` gives where one table holds all.

    A round passes the texts by every table and carries the best offer so far; then each text takes it
    or is done. The rounds are one more than languages in the largest set; the work is texts x
    tables by nature. Tables are counted anew in each round, so that no place holds two.
    """
    spark = rows.sparkSession
    empty = {"names": "array()", "shares": "array()", "rows": "X''", "pull": "NULL", "lang": "NULL", "row": "NULL", "over": "false"}
    types = dict(x.split() for x in STATE.split(", "))
    state = cut(rows.select("id", "v0", *[F.expr(f"CAST({v} AS {types[k]})").alias(k) for k, v in empty.items()]))
    schema, done = state.schema, []

    def each(f: Callable[[dict], None]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = b.to_pylist()
                for r in held:
                    f(r)
                yield pa.RecordBatch.from_pylist(held, schema=b.schema)

        return run

    def take(r: dict) -> None:
        _, mix = _mix(r)
        r["over"] = r["lang"] is None or not mix.take(r["lang"], np.frombuffer(r["row"], float))
        r |= {"names": mix.names, "shares": mix.shares.tolist(), "rows": mix.rows.tobytes(), "pull": None, "lang": None, "row": None}

    while not state.isEmpty():
        for langs, p in tables(labelled):
            if not langs:
                continue
            model = spark.sparkContext.broadcast(p)

            def offer(r: dict, langs=langs, model=model) -> None:
                grams, mix = _mix(r)
                best = mix.offer(langs, model.value[:, grams]) if len(grams) else None
                if best and (r["lang"] is None or (-best[0], best[1]) < (-r["pull"], r["lang"])):
                    r |= {"pull": best[0], "lang": best[1], "row": best[2].tobytes()}

            state, old = cut(map_rows(state, each(offer), schema)), state
            model.destroy()
            if not done:  # later rounds begin with a part of what is kept below
                drop_table(old)
        state = cut(map_rows(state, each(take), schema))
        done.append(state.filter("over"))
        state = state.filter("NOT over")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Mix(np.zeros(0), r["names"], np.array(r["shares"], float)).result() for r in b.select(["names", "shares"]).to_pylist()]
            yield _results(b.column(0), got)

    out = done[0] if done else state
    for more in done[1:]:
        out = out.unionByName(more)
    return map_rows(out.select("id", "names", "shares"), read, f"id long, {RESULT}")


RESULT = "lang_pred string, score double, langs array<struct<lang:string,share:double>>"


def _results(ids: pa.Array, got: list[tuple[str, float, list[dict]]], id_col: str = "id") -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    return pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], kind)], names=[id_col, "lang_pred", "score", "langs"])


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score (its share of the text), langs (the chosen set with shares).

    ``labelled`` (text, lang) is what the model learns from; rows without a lang
    teach nothing. A null text, one without a letter, or a model without
    languages gives ``und`` with score 0; ties go to the first name. Every row
    is judged by itself, also where ids are missing or repeat.
    """
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("lang is not null")
    rows, names = numbered(docs, id_col, text_col)
    if many(labelled):
        return named(by_tables(rows, labelled).withColumnRenamed("id", id_col), names, id_col)
    langs, p = train(labelled)
    model = docs.sparkSession.sparkContext.broadcast(p)  # at most MOST x 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _results(b.column(0), [predict(text, langs, model.value) for text in b.column(1).to_pylist()], id_col)

    return named(map_rows(rows, run, f"{id_col} long, {RESULT}"), names, id_col)


#: The learning rows of the query: the rest is held out.
FOLDS, HELD = 4, 2


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD


def identify_documents(docs: DataFrame) -> DataFrame:
    """identify(), learning from the documents' own lang outside the held-out fold."""
    return identify(docs, docs.filter(~held_out()).select("text", "lang"))


def keep_identified(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not ``und``: texts without a letter go, mixtures stay.

    Every row is judged by itself, also where ids are missing or repeat. Where no
    row has a lang to learn from, texts with a letter stay unnamed.
    """
    labelled = docs.filter(~F.coalesce(held_out(), F.lit(True))).select(F.col(text_col).alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.filter("lang is not null")
    if many(labelled):
        rows = cut((docs.withColumnRenamed(ROW, OWN) if ROW in docs.columns else docs).withColumn(ROW, F.monotonically_increasing_id()))
        known = by_tables(rows.select(F.col(ROW).alias("id"), F.col(text_col).alias("v0")), labelled).filter(F.col("lang_pred") != UNKNOWN)
        return as_they_were(rows.join(known.select(F.col("id").alias(ROW)), ROW, "left_semi"), docs)
    langs, p = train(labelled)
    model = docs.sparkSession.sparkContext.broadcast(p)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stay = [predict(text, langs, model.value)[0] != UNKNOWN if langs else len(trigrams(text)) > 0 for text in b.column(at).to_pylist()]
            yield b.filter(pa.array(stay, pa.bool_()))

    return map_rows(docs, run, docs.schema)
