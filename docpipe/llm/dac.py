"""Token ids as files of directly addressable codes.

Each id is split into chunks of ``bits`` bits, lowest first. Level 0 holds the first chunk of every id, level 1 the second
chunk of those ids that have more, and so on. One continuation bit for each code says whether its id goes on at the next
level; a rank directory (set bits before every block of 512) finds the place there. Any single token is read by at most one
rank per level, without decoding its neighbours.

A segment file: magic ``DPDAC1``, bits, levels, then sizes, document ids, document offsets and the levels, all little-endian,
a CRC-32 of all before it, and a line feed. Files are written in ascending order of document id (null ids first, equal ids by
text), one segment each, by Spark's own writer and committer: so any storage that Spark reaches will do, a task that is run
again leaves nothing behind, and the names of the files order like the documents. They are read back in the same way.

Defined results: a null text counts as empty; an empty text is just the end id; repeated rows are stored as often as they
occur; a text of more than ``segment_tokens`` tokens is a segment of its own; an empty table gives no segments; columns other
than doc_id and text are not stored. Ids are numbers, or texts of whole numbers.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docpipe.llm.bpe import byte_symbols, pieces
from docpipe.llm.storage import fresh_path, ship, written

MAGIC = b"DPDAC1"
_BLOCK = 512
_HEAD = struct.Struct("<6sBBQQ")
_BYTE_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Level:
    """One level: codes, continuation bits and the rank directory."""

    def __init__(self, codes: np.ndarray, bits: np.ndarray, directory: np.ndarray):
        self.codes, self.bits, self.directory = codes, bits, directory

    @classmethod
    def build(cls, codes: np.ndarray, more: np.ndarray) -> Level:
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more.astype(np.int64), np.arange(0, max(len(more), 1), _BLOCK)) if len(more) else np.zeros(0, np.int64)
        return cls(codes, bits, np.concatenate([[0], np.cumsum(per_block)]).astype("<u8"))

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block = at // _BLOCK
        out = self.directory[block].astype(np.int64)
        first, last = block * (_BLOCK // 8), at >> 3
        for k in range(_BLOCK // 8):  # whole bytes between the block's start and the place
            inside = first + k < last
            if not inside.any():
                break
            out[inside] += _BYTE_COUNTS[self.bits[(first + k)[inside]]]
        rest = (at & 7).astype(np.int64)
        tail = self.bits[np.minimum(last, max(len(self.bits) - 1, 0))].astype(np.int64) & ((1 << rest) - 1)
        return out + _BYTE_COUNTS[tail]


class Codes:
    """A sequence of non-negative integers with random access."""

    def __init__(self, size: int, bits: int, levels: list[Level]):
        self.size, self.bits, self.levels = size, bits, levels

    @classmethod
    def build(cls, values: np.ndarray, bits: int = 8) -> Codes:
        if bits not in (8, 16):
            raise ValueError("codes of 8 or 16 bits")
        own = np.uint32 if values.dtype == np.dtype("<u4") else np.uint64  # half the memory for token ids
        rest, levels = values.astype(own), []
        kind = np.uint8 if bits == 8 else np.dtype("<u2")
        while len(rest) or not levels:
            codes, rest = (rest & own((1 << bits) - 1)).astype(kind), rest >> own(bits)
            more = rest > 0
            levels.append(Level.build(codes, more))
            rest = rest[more]
        return cls(len(values), bits, levels)

    def __getitem__(self, at: int | np.ndarray) -> np.ndarray:
        """Values at the given places."""
        place = np.atleast_1d(np.asarray(at, np.int64))
        if len(place) and (place.min() < 0 or place.max() >= self.size):
            raise IndexError("no such place")
        out, todo, shift = np.zeros(len(place), np.int64), np.arange(len(place)), 0
        for level in self.levels:
            out[todo] |= level.codes[place].astype(np.int64) << shift
            on = level.goes_on(place)
            todo, place, shift = todo[on], level.rank(place[on]), shift + self.bits
            if not len(todo):
                break
        return out

    def all(self) -> np.ndarray:
        """Every value, level by level."""
        out, todo, shift = self.levels[0].codes.astype(np.int64), None, 0
        for level, deeper in zip(self.levels, self.levels[1:], strict=False):
            on = np.flatnonzero(np.unpackbits(level.bits, count=len(level.codes), bitorder="little"))
            todo, shift = on if todo is None else todo[on], shift + self.bits
            out[todo] |= deeper.codes.astype(np.int64) << shift
        return out


def pack_segment(doc_ids: list[int | None], sizes: np.ndarray, values: np.ndarray, bits: int = 8) -> bytes:
    codes = Codes.build(values, bits)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        _HEAD.pack(MAGIC, bits, len(codes.levels), len(doc_ids), codes.size),
        known.tobytes(),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(),
    ]
    for x in codes.levels:
        parts += [struct.pack("<QQQ", len(x.codes), len(x.bits), len(x.directory)), x.codes.tobytes(), x.bits.tobytes(), x.directory.tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """A segment file's content: documents and their tokens, each directly addressable."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size + 4 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a damaged segment file")
        magic, bits, n_levels, n_docs, size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment file")
        self._data, self._at = data, _HEAD.size
        self.known = self._take(np.uint8, n_docs).view(bool)
        self.doc_ids = self._take("<i8", n_docs)
        self.offsets = self._take("<u8", n_docs + 1).astype(np.int64)
        levels = []
        for _ in range(n_levels):
            a, b, c = struct.unpack_from("<QQQ", data, self._at)
            self._at += 24
            levels.append(Level(self._take(np.uint8 if bits == 8 else "<u2", a), self._take(np.uint8, b), self._take("<u8", c)))
        self.codes = Codes(size, bits, levels)

    def _take(self, kind: str | type, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def token(self, doc: int, place: int) -> int:
        """One token of the document with this index in the segment."""
        return int(self.codes[int(self.offsets[doc]) + place][0])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, place of its first token in the segment, its tokens."""
        values = self.codes.all()
        for i, d in enumerate(self.doc_ids.tolist()):
            a, b = int(self.offsets[i]), int(self.offsets[i + 1])
            yield d if self.known[i] else None, a, values[a:b]


class _Parts(dict):
    """Ids of what the pattern cuts, coded when first asked for. A full table becomes the ``old`` one of the next, which takes over what is used again."""

    def __init__(self, code: Callable[[str], bytes], old: dict[str, bytes]):
        self.code, self.old = code, old

    def __missing__(self, part: str) -> bytes:
        got = self[part] = self.old.get(part) or self.code(part)
        return got

    def next(self) -> _Parts:
        self.old = {}
        return _Parts(self.code, self)


class ByteBpe:
    """Whole-text ids of a byte-level vocabulary of the ``tokenizers`` library, with the work for repeated words done once.

    Where white space follows something else a text falls apart, whatever stands around. Up to U+024F the vocabulary's pattern
    is stated here and cuts a text into parts, which the library's model codes. Beyond that it depends on the library's Unicode
    tables what a letter is, so what stands between white space goes to the library with such a character in it. Texts with
    white space other than spaces and line feeds go there whole, as do those with special strings.
    """

    _LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
    _PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
    _LATIN = re.compile(_PATTERN)
    _MIXED = re.compile(rf" ?[^\sɐ-\U0010ffff]*[^\s\x00-ɏ]\S*|{_PATTERN}")
    _BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")
    _OTHER_WHITE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _BORDER = re.compile(r"\S(?=\s)")
    _HELD, _AT_ONCE = 300_000, 1 << 20  # parts in the new and in the old table, each; characters of a long text

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.tokenize = self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.symbols = dict(enumerate(byte_symbols()))
        self.space = self.symbols[32]
        self.parts = _Parts(self._coded, {})

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _coded(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            symbols = part.replace(" ", self.space)  # the others are their own symbols
        elif self._BEYOND_LATIN.search(part):
            return self._ids(part)
        else:
            symbols = part.encode().decode("latin-1").translate(self.symbols)
        ids = [t.id for t in self.tokenize(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cut(self, text: str) -> Iterator[str]:
        """A long text in pieces that end where white space follows."""
        begin = 0
        while len(text) - begin > self._AT_ONCE and (m := self._BORDER.search(text, begin + self._AT_ONCE)):
            yield text[begin : m.end()]
            begin = m.end()
        yield text[begin:]

    def _text(self, text: str) -> bytes:
        if self._OTHER_WHITE.search(text) or any(s in text for s in self.special):
            return self._ids(text)
        pattern = self._LATIN if text.isascii() or not self._BEYOND_LATIN.search(text) else self._MIXED
        out = []
        for piece in self._cut(text):
            out.append(b"".join(map(self.parts.__getitem__, pattern.findall(piece))))
            if len(self.parts) > self._HELD:
                self.parts = self.parts.next()
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [self._text(t) if t else b"" for t in texts]


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _files(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("path", "content").where(F.length("content") > 0)


def _heads(files: DataFrame) -> DataFrame:
    """(segment_part, segment_no, path, n_docs, n_tokens) of segment files, by their names and heads."""
    name, digits = r"part-(\d+)-.*-c(\d+)\.\w+$", F.hex(F.substring("content", 1, _HEAD.size))

    def number(at: int) -> Column:
        return F.conv(F.concat(*[F.substring(digits, 2 * (at + k) + 1, 2) for k in reversed(range(8))]), 16, 10).cast("long")

    checked = F.when(F.substring(digits, 1, 2 * len(MAGIC)) == MAGIC.hex().upper(), number(8)).otherwise(F.raise_error(F.lit("not a segment file")).cast("long"))
    parts = [F.regexp_extract("path", name, k).cast("int").alias(c) for k, c in ((1, "segment_part"), (2, "segment_no"))]
    return files.where(F.col("path").rlike(name)).select(*parts, "path", checked.alias("n_docs"), number(16).alias("n_tokens"))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None, segment_tokens: int = 1 << 21, bits: int = 8) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write segment files into the new folder ``out``; returns the manifest, in order of its first token.

    ``out`` must be a folder that all executors share; by default a new one in ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    out = out or fresh_path(spark, "tokens")
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        blobs: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, blobs, held
            sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
            data = pack_segment(ids, sizes, np.frombuffer(b"".join(blobs), "<u4"), bits)
            ids, blobs, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["content"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                for d, coded in zip(piece.column("doc_id").to_pylist(), codec.encode(piece.column("text").to_pylist()), strict=True):
                    ids.append(d)
                    blobs.append(coded + end)
                    held += len(blobs[-1]) // 4
                    if held >= segment_tokens:
                        yield flush()
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    segments = ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string"))
    # Bytes as they are, and one record for each file.
    segments.write.option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(out)
    found = written(_heads(_files(spark, out)), "manifest")
    # Places of first tokens: sums of whole parts first, then inside each part, so no task sees all segments.
    parts = found.groupBy("segment_part").agg(F.sum("n_tokens").alias("part_tokens"))
    grouped = parts.withColumn("block", F.floor(F.col("segment_part") / 1000))
    blocks = grouped.groupBy("block").agg(F.sum("part_tokens").alias("block_tokens"))
    before = blocks.withColumn("block_start", F.coalesce(F.sum("block_tokens").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("block_tokens")
    in_block = F.coalesce(F.sum("part_tokens").over(Window.partitionBy("block").orderBy("segment_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = grouped.withColumn("in_block", in_block).join(before, "block").select("segment_part", (F.col("block_start") + F.col("in_block")).alias("part_start"))
    in_part = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("segment_part").orderBy("segment_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("in_part", in_part).join(starts, "segment_part").select("segment_part", "segment_no", "path", "n_docs", "n_tokens", (F.col("part_start") + F.col("in_part")).alias("first_token"))


def read_tokens(manifest: DataFrame, each: Callable[[np.ndarray], dict] | None = None, columns: str = "") -> DataFrame:
    """One row for each stored document: doc_id, start (tokens of all documents before it), n_tokens.

    ``each`` turns a document's ids into more columns, whose types ``columns`` names; without it, ``token_ids`` follows.
    """
    spark = manifest.sparkSession
    ship(spark)
    more = columns if each else "token_ids array<long>"
    names = ["path", "doc_id", "at", "n_tokens", *[x.split()[0] for x in more.split(",")]]
    schema = f"path string, doc_id long, at long, n_tokens long, {more}"
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    first = manifest.first()
    if first is None:
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {more}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                columns: dict[str, list] = {n: [] for n in names[1:]}
                held = 0
                for d, at, ids in Segment(data.as_py()[:-1]).documents():
                    more_of = each(ids) if each else {"token_ids": ids}
                    for n, v in (("doc_id", d), ("at", at), ("n_tokens", len(ids)), *more_of.items()):
                        columns[n].append(v)
                    held += 1 if each else len(ids)
                    if held > 1_000_000:
                        yield made(path, columns)
                        held = 0
                yield made(path, columns)

    def made(path: str, columns: dict[str, list]) -> pa.RecordBatch:
        n = len(columns["doc_id"])
        out = pa.RecordBatch.from_arrays([pa.array(x, kinds.field(c).type) for c, x in ({"path": [path] * n} | columns).items()], schema=kinds)
        for x in columns.values():
            x.clear()
        return out

    found = _files(spark, first["path"].rpartition("/")[0]).mapInArrow(run, schema)
    return found.join(manifest.select("path", "first_token"), "path").select("doc_id", (F.col("first_token") + F.col("at")).alias("start"), *names[3:])


def crc(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4"))}


def open_segment(spark: SparkSession, path: str) -> Segment:
    """A segment for random access on the driver."""
    return Segment(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])[:-1])
