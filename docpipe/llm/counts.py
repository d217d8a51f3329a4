"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where their encodings must agree.

A text longer than ``chunk`` bytes is encoded in chunks that overlap. The place before a space that follows another character
is *stable* if no vocabulary piece has a space inside after another character: no merge can ever cross it, so the tokens on
either side don't depend on the other side. Two neighbouring chunks are spliced at a stable place in their overlap at which
both encodings, with offsets, do have a token boundary. An overlap without such a place is widened, at last to the end of the
text. A vocabulary without this property is never chunked.

Defined results: a null text counts as empty, 0 bytes and 0 tokens; rows, repeated rows and null ids are kept as they are; an
empty table gives no rows; extra columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from docpipe.llm.bpe import pieces
from docpipe.llm.names import others
from docpipe.llm.storage import ship

SPACE = "▁"


class PieceCounter:
    """Counts tokens as a ``sentencepiece`` model gives them."""

    def __init__(self, path: str, chunk: int = 1 << 15, overlap: int = 1 << 10):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.unknown = self.library.unk_id()
        self.width = np.array([1 if self.library.is_byte(i) else len(x.replace(SPACE, " ").encode()) for i, x in enumerate(names)], np.int64)
        inside = any(a != SPACE and b == SPACE for x in names for a, b in zip(x, x[1:]))
        plain = self.library.encode("a b", out_type=str)[0].startswith(SPACE) and self.library.encode("a  b ﬁ\n", out_type=int) != self.library.encode("a b fi", out_type=int)
        self.can_chunk = plain and not inside

    def count_all(self, texts: list[str]) -> list[int]:
        """Counts of texts, those of equal texts made once."""
        short = list(dict.fromkeys(t for t in texts if not self._huge(t)))
        known = dict(zip(short, map(len, self.library.encode(short, num_threads=1)), strict=True)) if short else {}
        for t in texts:
            if t not in known:
                known[t] = self.spliced(t)
        return [known[t] for t in texts]

    def _huge(self, text: str) -> bool:
        return self.can_chunk and (len(text) > self.chunk or len(text) * 4 > self.chunk and len(text.encode("utf-8", "surrogatepass")) > self.chunk)

    def _cut(self, data: bytes, at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def _starts(self, data: bytes, begin: int, end: int) -> np.ndarray | None:
        """Offsets in ``data`` at which the tokens of ``data[begin:end]`` start; the library puts a space before the chunk, which takes the place of one that is there."""
        own = begin > 0 and data[begin] == 32
        ids = np.array(self.library.encode(data[begin + own : end].decode()), np.int64)
        if self.unknown in ids:
            return None
        return begin + own - 1 + np.concatenate([[0], np.cumsum(self.width[ids])])[:-1]

    def spliced(self, text: str) -> int:
        if "\x00" in text:
            return len(self.library.encode(text))
        data = text.replace(SPACE, " ").encode()
        total, begin, n = 0, 0, len(data)
        while True:
            next_at = self._cut(data, begin + self.chunk)
            wide = self.overlap
            while True:
                end = self._cut(data, next_at + wide)
                ours = self._starts(data, begin, end)
                if ours is None:
                    return len(self.library.encode(text))
                if end >= n:
                    return total + len(ours)
                at = self._splice(data, ours, next_at, end)
                if at is not None:
                    break
                wide *= 2
            total += int((ours < at).sum())
            begin = at

    def _splice(self, data: bytes, ours: np.ndarray, next_at: int, end: int) -> int | None:
        """A stable place in data[next_at:end] at which both chunks have a token boundary."""
        theirs = self._starts(data, next_at, min(len(data), end + self.overlap) if end + self.overlap >= len(data) else self._cut(data, end + self.overlap))
        if theirs is None:
            return None
        both = np.intersect1d(ours[(ours > next_at) & (ours < end)], theirs)
        for p in both.tolist():
            if data[p] == 32 and data[p - 1] != 32:
                return p
        return None


_LOADED: dict[tuple[str, int, int], PieceCounter] = {}


def piece_counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    key = (path, chunk, overlap)
    if key not in _LOADED:
        _LOADED[key] = PieceCounter(*key)
    return _LOADED[key]


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """Add n_bytes (UTF-8) and n_tokens of ``text``; columns of these names are replaced."""
    kept = others(docs.columns, ("n_bytes", "n_tokens"))
    docs = docs.select(*[docs[f"`{c}`"] for c in kept])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path, chunk, overlap)
        for batch in batches:
            for part in pieces(batch, text):
                column = part.column(text)
                size = pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())
                counts = counter.count_all([t or "" for t in column.to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, size, pa.array(counts, pa.int64())], names=[*kept, "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, schema)
