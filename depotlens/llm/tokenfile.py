"""Token ids as raw binary shards with a minimal perfect hash index.

A store is a folder with ``shards`` and ``manifest``. A shard is one file:

    ids      unsigned little-endian, of 16 bits where the vocabulary allows it, else of 32;
             documents in ascending order, END_ID behind each
    index    bits and ranks of the perfect hash, one SLOT for each document, one DOC for each document
    trailer  TRAILER and the separator

Shards follow each other in document order, so their ids together are one
gapless array over the corpus. A slot holds a fingerprint of the key and where its ids
are; ``get`` reads the trailer, a word and a rank for each level it needs, one slot and
the ids, however large the shard is. The manifest has one row for each shard: the
range of its keys, its tokens and the tokens before it.

Shards are written by Spark's text writer, one record to a document: its record
separator, zero bytes, *is* END_ID. So any file system that Spark can write to
holds the raw bytes, and the commit protocol keeps what a lost or repeated task
wrote out of the store. Texts are dealt by ranges of the key, so no table is
gathered anywhere; a shard should stay below 2 GB, which Spark can read as one file.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, by_row, map_rows
from .shingles import mix

END_ID = 0
#: Bytes of text to a shard, about.
SHARD_BYTES = 32_000_000
#: Units whose ids a worker remembers (twice as many for a while), and the longest one, in characters.
CACHE, LONGEST = 300_000, 48

SLOT = np.dtype([("mark", "<u4"), ("n", "<u4"), ("at", "<u8")])
DOC = np.dtype([("key", "<i8"), ("doc_id", "<i8"), ("known", "<u4")])
#: Magic, bytes of an id, bytes of all ids, bytes of the index, documents, first and last key.
TRAILER = ">4s i q q q q q"
MAGIC, TAIL = b"DTOK", struct.calcsize(TRAILER)


# ids of texts

#: Unicode's white space, as the splitter takes it, and Latin letters.
WHITE, LETTER = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
UNIT = re.compile(f" ?[{LETTER}]+(?=[{WHITE}.,;:!?])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_HELD: dict[str, "UnitIds"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_bytes(vocabulary: int) -> int:
    """Bytes of an id in a shard: two, where all ids fit."""
    return 2 if vocabulary <= 1 << 16 else 4


class UnitIds(dict):
    """Ids of texts by a byte-level tokenizer; those of words that come again are remembered.

    The tokenizer's splitter never joins what a single blank, a run of white space
    or the end of a word of letters parts, so a text is cut into units there, whose
    ids are independent. Words of Latin letters go to the model without the
    splitter. Texts with the string of a special token are encoded whole, and so is
    every text where the tokenizer has a normaliser or another splitter.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = t = Tokenizer.from_file(path)
        self.width = id_bytes(t.get_vocab_size(with_added_tokens=True))
        self.kind = f"<u{self.width}"
        self.special = [a.content for a in t.get_added_tokens_decoder().values()]
        splitter = t.pre_tokenizer
        self.by_unit = t.normalizer is None and type(splitter).__name__ == "ByteLevel" and splitter.use_regex and not splitter.add_prefix_space
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.spelt = {b: 256 + k for k, b in enumerate(hidden)}  # how the model spells bytes that are not printable
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "UnitIds":
        if path not in _HELD:
            _HELD[path] = cls(path)
        return _HELD[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            word = unit[1:] if unit[0] == " " else unit
            if word.isalpha() and max(word) < "\u0250" and "\xaa" not in word and "\xb5" not in word and "\xba" not in word:
                spelt = unit.encode().decode("latin-1").translate(self.spelt)
                ids = b"".join([t.id.to_bytes(self.width, "little") for t in self.tokenizer.model.tokenize(spelt)])
            else:
                ids = self.whole(unit)
        if len(unit) <= LONGEST:
            self[unit] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes, without the end id."""
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()
        ids = self.__getitem__
        plain = lambda x: self.by_unit and not any(s in x for s in self.special)
        return [b"".join(map(ids, UNIT.findall(x))) if plain(x) else self.whole(x) for x in texts]


# the index


class PerfectHash:
    """Distinct numbers to 0 .. n-1, without gaps: bit arrays in levels.

    A key that hits a bit of its level alone keeps it; the others go to the next
    level. The place of a key is the rank of its bit, of which every 64th is stored.
    """

    #: Bits to a key.
    ROOM = 2

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.cumsum(sizes) - sizes

    @staticmethod
    def position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64(level * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D & (1 << 64) - 1)
        return (mix(keys.astype("<u8") ^ seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, bits = [], []
        while len(keys):
            if len(sizes) > 200:
                raise ValueError("keys repeat")
            size = -(-cls.ROOM * len(keys) // 64) * 64
            at = cls.position(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(flat, bitorder="little").view("<u8")
        ranks = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
        return cls(np.array(sizes, np.int64), words, ranks.astype("<u4"))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for keys that no level knows (a foreign key may get a place)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist(), strict=True)):
            bit = start + self.position(keys[left], level, size)
            word, shift = self.words[bit // 64], (bit % 64).astype("<u8")
            hit = (word >> shift) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[bit[hit] // 64] + np.bitwise_count(below)
            left = left[~hit]
            if not len(left):
                break
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype("<u8") ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")


def pack_index(keys: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """The index of a shard whose documents have these keys and so many ids, end id included, in file order."""
    table = PerfectHash.build(keys)
    slots, docs = np.zeros(len(keys), SLOT), np.zeros(len(keys), DOC)
    place = table.places(keys)
    slots["mark"][place], slots["n"][place], slots["at"][place] = fingerprint(keys), sizes, np.cumsum(sizes) - sizes
    docs["key"], docs["known"] = keys, [i is not None for i in doc_ids]
    docs["doc_id"] = [0 if i is None else i for i in doc_ids]
    head = np.array([len(table.sizes), len(table.words), *table.sizes], "<i8")
    return b"".join(x.tobytes() for x in (head, table.words, table.ranks, slots, docs))


def read_trailer(tail: bytes) -> tuple[int, int, int]:
    """(bytes of an id, bytes of all ids, documents) from the last TAIL + 4 bytes of a shard; how long its separator is shows in it."""
    for width in (2, 4):
        magic, found, size, _, n, _, _ = struct.unpack_from(TRAILER, tail, len(tail) - TAIL - width)
        if (magic, found) == (MAGIC, width):
            return width, size, n
    raise ValueError("not a token shard")


class Shard:
    """The bytes of one shard file."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        self.width, self.size, n = read_trailer(content[-TAIL - 4 :])
        at = self.size
        levels, words = np.frombuffer(content, "<i8", 2, at).tolist()
        sizes = np.frombuffer(content, "<i8", levels, at + 16)
        at += 16 + 8 * levels
        bits = np.frombuffer(content, "<u8", words, at)
        ranks = np.frombuffer(content, "<u4", words, at + 8 * words)
        at += 12 * words
        self.table = PerfectHash(sizes, bits, ranks)
        self.slots = np.frombuffer(content, SLOT, n, at)
        self.docs = np.frombuffer(content, DOC, n, at + n * SLOT.itemsize)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key begin and how many they are; -1 and 0 for keys that the shard doesn't hold."""
        place = self.table.places(keys)
        if not len(self.slots):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slot = self.slots[place]
        ok = (place >= 0) & (slot["mark"] == fingerprint(keys))
        return np.where(ok, slot["at"].astype(np.int64), -1), np.where(ok, slot["n"].astype(np.int64), 0)

    def ids(self, at: int, n: int) -> bytes:
        """As unsigned 32-bit little-endian numbers."""
        return np.frombuffer(self.content, f"<u{self.width}", n, self.width * at).astype("<u4").tobytes()


# writing and reading


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text and write a store at ``path``, which must not exist.

    A null text is empty: its ids are the end id alone. The key of a document is its
    id; where ids are missing or repeat, it is the row's place in id order, rows
    without an id first, and every row is written. Other columns are not read. An
    empty table gives a store without documents.
    """
    place = tokenizer or default_tokenizer()
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, _ = by_row(known, "doc_id", "text")
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    width = UnitIds.of(place).width
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, keys, ids, sizes, written = UnitIds.of(place), [], [], [], 0
        give = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])
        for b in batches:
            values = encoder.encode([x or "" for x in b["text"].to_pylist()])
            keys += b[ROW].to_pylist()
            ids += b["doc_id"].to_pylist()
            sizes += [len(v) // width + 1 for v in values]
            yield give(values)
        if keys:
            index = pack_index(np.array(keys, np.int64), ids, np.array(sizes, np.int64))
            yield give([index, struct.pack(TRAILER, MAGIC, width, width * sum(sizes), len(index), len(keys), keys[0], keys[-1])])

    ranged = rows.select(ROW, "doc_id", "text").repartitionByRange(shards, ROW).sortWithinPartitions(ROW)
    out = map_rows(ranged, run, "value binary")
    out.select(F.col("value").cast("string")).write.option("lineSep", "\0" * width).text(f"{path}/shards")
    _write_manifest(spark, path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, path, content): shards are numbered by the writer's partitions."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    return files.filter(F.col("length") > TAIL + 4).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path", "content")


def _write_manifest(spark: SparkSession, path: str) -> None:
    tail = _files(spark, path).select("shard", "path", F.substring("content", -TAIL - 4, TAIL + 4).alias("tail"))
    skip = F.when(F.substring("tail", 3, 4) == F.lit(MAGIC), 2).otherwise(0)  # the separator is as long as an id
    number = lambda at, n=8: F.conv(F.hex(F.substr("tail", skip + at, F.lit(n))), 16, -10).cast("long")
    rows = tail.select("shard", "path", number(5, 4).alias("width"), number(9).alias("size"), number(25).alias("docs"), number(33).alias("first_key"), number(41).alias("last_key"))
    rows = rows.withColumn("tokens", F.call_function("div", "size", "width")).drop("size")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each shard
    rows.withColumn("before", before).write.parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(key, doc_id, start, n_tokens, ids) of every document, found through the index of its shard; ``start`` counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, content in zip(b["shard"].to_pylist(), b["content"], strict=True):
                shard = Shard(content.as_buffer().to_pybytes())
                for i in range(0, len(shard.docs), 500):
                    docs = shard.docs[i : i + 500]
                    at, n = shard.find(docs["key"])
                    if (at < 0).any():
                        raise ValueError("a document is not in the index of its shard")
                    ids = [shard.ids(a, k) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                    columns = [pa.array([number] * len(docs), pa.int32()), pa.array(docs["key"]), pa.array(docs["doc_id"], mask=docs["known"] == 0), pa.array(at), pa.array(n), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "key", "doc_id", "at", "n_tokens", "ids"])

    found = _one_file(_files(spark, path).select("shard", "content"), run, "shard int, key long, doc_id long, at long, n_tokens long, ids binary")
    return found.join(read_manifest(spark, path).select("shard", "before"), "shard").select("key", "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def _one_file(files: DataFrame, run, schema: str) -> DataFrame:
    """Over file contents, in Arrow batches of few files, as one may be large."""
    spark = files.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str(2**64 - 1), "-1", "9223372036854775807", "18446744073709551615b"):
        spark.conf.set(key, str(2 * SHARD_BYTES))
    return files.mapInArrow(run, schema)


def lookup(keys: DataFrame, path: str, key_col: str = "key") -> DataFrame:
    """(key, ids) of each wanted key that the store holds; repeated and null keys count once and never.

    Keys meet the shard whose range holds them, by a range join with the manifest, then the shard's file
    by an equi-join; only files that are asked are read, and each is opened once.
    """
    spark = keys.sparkSession
    wanted = keys.select(F.col(key_col).cast("long").alias("key")).filter("key IS NOT NULL").distinct()
    manifest = read_manifest(spark, path).select("shard", "first_key", "last_key")
    placed = wanted.join(F.broadcast(manifest), F.col("key").between(F.col("first_key"), F.col("last_key")))  # one row for each shard
    asked = placed.groupBy("shard").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most the documents of one shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, want in zip(b["content"], b["keys"].to_pylist(), strict=True):
                shard, want = Shard(content.as_buffer().to_pybytes()), np.array(want, np.int64)
                at, n = shard.find(want)
                ok = np.flatnonzero(at >= 0)
                ids = [shard.ids(a, k) for a, k in zip(at[ok].tolist(), n[ok].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(want[ok]), pa.array(ids, pa.binary())], names=["key", "ids"])

    return _one_file(_files(spark, path).join(asked, "shard").select("content", "keys"), run, "key long, ids binary")


class Reader:
    """Single documents by key, with a handful of small reads each, from any file system of Spark's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        rows = read_manifest(spark, path).orderBy("first_key").collect()  # one row for each shard
        self.rows, self.first = rows, np.array([r.first_key for r in rows], np.int64)

    def _at(self, stream, place: int, n: int) -> bytes:
        stream.seek(place)
        return bytes(stream.readNBytes(n))

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, its end id last; None if there is none of this key (or one in 2^32 foreign keys)."""
        k = int(np.searchsorted(self.first, key, "right")) - 1
        if k < 0 or key > self.rows[k].last_key:
            return None
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.rows[k].path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        end = fs.getFileStatus(place).getLen()
        stream = fs.open(place)
        try:
            width, base, _ = read_trailer(self._at(stream, end - TAIL - 4, TAIL + 4))
            levels, words = np.frombuffer(self._at(stream, base, 16), "<i8").tolist()
            sizes = np.frombuffer(self._at(stream, base + 16, 8 * levels), "<i8")
            bits = base + 16 + 8 * levels
            one, start = np.array([key], np.int64), 0
            for level, size in enumerate(sizes.tolist()):
                bit = start + int(PerfectHash.position(one, level, size)[0])
                word = int.from_bytes(self._at(stream, bits + 8 * (bit // 64), 8), "little")
                if word >> bit % 64 & 1:
                    rank = int.from_bytes(self._at(stream, bits + 8 * words + 4 * (bit // 64), 4), "little")
                    slot = rank + (word & (1 << bit % 64) - 1).bit_count()
                    mark, size_, at = np.frombuffer(self._at(stream, bits + 12 * words + SLOT.itemsize * slot, SLOT.itemsize), SLOT)[0].tolist()
                    return np.frombuffer(self._at(stream, width * at, width * size_), f"<u{width}").astype("<u4") if mark == fingerprint(one)[0] else None
                start += size
            return None
        finally:
            stream.close()
