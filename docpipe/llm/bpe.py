"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into its longest vocabulary tokens. That guess is the true BPE result exactly when every
adjacent pair of its tokens is *compatible*: when no merge can happen across the border while the two tokens are being
built. Compatibility is decided for whole arrays of pairs at once by walking the right spine of the left token's merge
tree and the left spine of the right token's, latest merge first. Only words with an incompatible pair are merged step by
step. The proof needs merges whose parts always have lower ranks and products made by one merge only; both are checked when
a vocabulary is loaded, and where they fail every word is merged step by step.

Defined results: a null text counts as the empty text; the empty text has no tokens and decodes to the empty text; other
columns are kept, except that columns named like an output are replaced; row order, repeated rows and null ids are kept; a very
long text is coded whole in one task; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

from docpipe.llm.names import others
from docpipe.llm.storage import ship

_LAST = 0x2000  # added to the code point of a word's last symbol, which stands for the word-end mark
_OWN_WHITE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_BEYOND_LATIN = re.compile(r"[^\x00-įı-ɏ]")
_CACHED_CHUNKS = 150_000  # in the new and in the old table, each
_CACHED_WORDS = 200_000
_SHORT = 200
_BATCH_BYTES = 1_500_000


def byte_symbols() -> list[str]:
    """The printable symbol that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class PairTable:
    """Merge rank of token pairs, looked up for arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, size: int):
        self.size = np.int64(size)
        keys = left.astype(np.int64) * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks; -1 where there is no such merge."""
        want = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], -1)


class WordBpe:
    """Byte-level BPE with a word-end mark, as in a ``tokenizers`` JSON file of that kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or not self.suffix or model["dropout"] or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE vocabulary with an end-of-word suffix is needed")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        vocab = model["vocab"]
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        n = 1 + max(self.text_of)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a.removesuffix(self.suffix) + b if a.endswith(self.suffix) else a + b] for a, b in pairs], np.int64)
        self.table, self.made = PairTable(left, right, n), made
        self.made_list = made.tolist()
        self.rank_of = {(a, b): r for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank[made] = np.arange(len(pairs))
        self.left[made], self.right[made] = left, right
        order = np.arange(len(pairs))
        self.sound = len(set(made.tolist())) == len(pairs) and bool(((self.rank[left] < order) & (self.rank[right] < order)).all())
        self.known_pairs: dict[int, bool] = {}
        # A full table becomes the old one, from which what is met again is taken over.
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.old_cache: dict[str, tuple[bytes, str]] = {}
        self.word_ids: dict[str, bytes] = {}
        self.word_text: dict[str, str] = {}
        self.old_ids: dict[str, bytes] = {}
        self.old_text: dict[str, str] = {}
        symbols = byte_symbols()
        self.to_symbols = {b: s for b, s in enumerate(symbols)}
        own = self._valid_tokens(left, right, made) if self.sound else np.zeros(n, bool)
        self.greedy: dict[str, int] = {}
        self.reach: dict[str, int] = {}
        self.symbol_id: dict[str, int] = {}
        for t, i in vocab.items():
            key = self._shift(t[: -len(self.suffix)]) if t.endswith(self.suffix) and len(t) > len(self.suffix) else t
            if len(key) == 1:
                self.symbol_id[key] = i
            if len(key) == 1 or own[i]:
                self.greedy[key] = i
                self.reach[key[:3]] = max(self.reach.get(key[:3], 1), len(key))

    @staticmethod
    def _shift(word: str) -> str:
        return word[:-1] + chr(ord(word[-1]) + _LAST)

    def _valid_tokens(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which tokens are what BPE makes of their own text."""
        fits = self._compatible(left, right, inner=True)
        own = self.rank < 0
        for a, b, t, ok in zip(left.tolist(), right.tolist(), made.tolist(), fits.tolist(), strict=True):
            own[t] = ok and own[a] and own[b]
        return own

    def _compatible(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """For each pair of tokens: whether BPE of their joined text gives just these two. ``inner``: let the two themselves merge."""
        top = np.int64(1 << 40)
        x, y = a.astype(np.int64), b.astype(np.int64)
        over_x, over_y = np.full(len(x), top), np.full(len(x), top)  # rank at which x and y were merged away
        good, active, first = np.ones(len(x), bool), np.arange(len(x)), inner
        while len(active):
            xa, ya = x[active], y[active]
            m, rx, ry = self.table.rank(xa, ya), self.rank[xa], self.rank[ya]
            hit = (m > rx) & (m > ry) & (m < over_x[active]) & (m <= over_y[active])
            if first:
                hit[:], first = False, False
            good[active[hit]] = False
            go = ~hit & ((rx >= 0) | (ry >= 0))
            active, xa, ya, rx, ry = active[go], xa[go], ya[go], rx[go], ry[go]
            down_y = ry >= rx  # equal ranks: the left one merged first
            ix, iy = active[~down_y], active[down_y]
            over_x[ix], x[ix] = rx[~down_y], self.right[xa[~down_y]]
            over_y[iy], y[iy] = ry[down_y], self.left[ya[down_y]]
        return good

    def merged(self, word: str) -> list[int]:
        """Exact BPE of one shifted word: lowest rank first, then leftmost."""
        ids = [self.symbol_id[c] for c in word]
        return self._merged_long(ids) if len(ids) > _SHORT else self._merged_short(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        get, none = self.rank_of.get, 1 << 40
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i] = self.made_list[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made_list[r], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (s := self.rank_of.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def _guess(self, word: str) -> list[int]:
        out, at, n, greedy, reach = [], 0, len(word), self.greedy, self.reach
        while at < n:
            for k in range(min(reach.get(word[at : at + 3], 2), n - at), 0, -1):
                if (t := greedy.get(word[at : at + k])) is not None:
                    out.append(t)
                    at += k
                    break
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of shifted words (see :meth:`shifted`)."""
        if not self.sound:
            return [self.merged(w) for w in words]
        out = [self._guess(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        if not sizes.sum():
            return out
        flat = np.fromiter((i for x in out for i in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        inside = owner[1:] == owner[:-1]
        a, b, who = flat[:-1][inside], flat[1:][inside], owner[1:][inside]
        keys, back = np.unique(a * self.table.size + b, return_inverse=True)
        for w in np.unique(who[~self._known(keys)[back]]).tolist() if len(keys) else ():
            out[w] = self.merged(words[w])
        return out

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if len(self.known_pairs) > 500_000:
            self.known_pairs.clear()
        new = np.array([k for k in keys.tolist() if k not in self.known_pairs], np.int64)
        if len(new):
            self.known_pairs.update(zip(new.tolist(), self._compatible(new // self.table.size, new % self.table.size).tolist(), strict=True))
        return np.fromiter(map(self.known_pairs.__getitem__, keys.tolist()), bool, len(keys))

    def shifted(self, word: str) -> str:
        return self._shift(word.encode().decode("latin-1").translate(self.to_symbols))

    def chunks(self, text: str) -> list[str]:
        """Parts between white space; special tokens stand alone."""
        if self.special_pattern and "<|" in text and self.special_pattern.search(text):
            return [c for part in self.special_pattern.split(text) for c in ([part] if part in self.special else self._plain_chunks(part))]
        return self._plain_chunks(text)

    @staticmethod
    def _plain_chunks(text: str) -> list[str]:
        return [c for c in _OWN_WHITE.split(text) if c] if _SEPARATORS.search(text) else text.split()

    def _coded(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}i", *ids), " ".join([self.text_of[i] for i in ids])

    def learn(self, chunks: set[str]) -> None:
        """Put chunks that aren't cached into the cache."""
        new = [c for c in chunks if c not in self.cache]
        if len(self.cache) + len(new) > _CACHED_CHUNKS:
            self.cache, self.old_cache, new = {}, self.cache, list(chunks)
        cache, new = self.cache, _taken_over(self.cache, self.old_cache, new)
        words: dict[str, list[str]] = {}
        for c in new:
            if c in self.special:
                cache[c] = self._coded([self.special[c]])
            elif _BEYOND_LATIN.search(c):
                cache[c] = self._coded(self.library.encode(c, add_special_tokens=False).ids)
            else:
                words[c] = self.words.findall(c.lower())
        self.learn_words({w for x in words.values() for w in x})
        for c, x in words.items():
            cache[c] = b"".join([self.word_ids[w] for w in x]), " ".join([self.word_text[w] for w in x])

    def learn_words(self, words: set[str]) -> None:
        """Put words that aren't cached into the cache."""
        fresh = {w for w in words if w not in self.word_ids}  # a difference from a view would go through the whole table
        if len(self.word_ids) + len(fresh) > _CACHED_WORDS:
            self.old_ids, self.old_text, self.word_ids, self.word_text, fresh = self.word_ids, self.word_text, {}, {}, words
        again = fresh & self.old_ids.keys()
        self.word_ids.update((w, self.old_ids[w]) for w in again)
        self.word_text.update((w, self.old_text[w]) for w in again)
        todo = list(fresh - again)
        for w, (ids, text) in zip(todo, map(self._coded, self.encode_words([self.shifted(w) for w in todo])), strict=True):
            self.word_ids[w], self.word_text[w] = ids, text

    def _falls_apart(self, text: str) -> bool:
        """Whether the words of the text are those of its chunks: nothing to normalise, no special tokens, usual white space."""
        return ("<|" not in text or not self.special_pattern) and (text.isascii() or not _BEYOND_LATIN.search(text)) and not _SEPARATORS.search(text)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """For each text its ids as little-endian 32-bit integers, and their decoded text."""
        ids, decoded = [b""] * len(texts), [""] * len(texts)
        plain = {n: self.words.findall(t.lower()) for n, t in enumerate(texts) if t and self._falls_apart(t)}
        self.learn_words(set().union(*plain.values()))
        id_of, text_of = self.word_ids.__getitem__, self.word_text.__getitem__
        for n, x in plain.items():
            ids[n], decoded[n] = b"".join(map(id_of, x)), " ".join(map(text_of, x))
        chunks = {n: self.chunks(t) for n, t in enumerate(texts) if t and n not in plain}
        self.learn(set().union(*chunks.values()))
        for n, x in chunks.items():
            pairs = [p for p in map(self.cache.__getitem__, x) if p[0]]
            ids[n], decoded[n] = b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])
        return ids, decoded


def _taken_over(into: dict, old: dict, keys: Iterable) -> list:
    """Move what ``old`` has of ``keys`` and give the rest."""
    left = []
    for k in keys:
        v = old.get(k)
        if v is None:
            left.append(k)
        else:
            into[k] = v
    return left


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The codec for a vocabulary file, loaded once in a process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def pieces(batch: pa.RecordBatch, column: str, limit: int = _BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has few bytes of text, or one row."""
    sizes = np.diff(np.frombuffer(_offsets(batch.column(column)), np.int64)) if batch.num_rows else np.array([], np.int64)
    begin, total = 0, 0
    for i, k in enumerate(sizes.tolist()):
        if total and total + k > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += k
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _offsets(column: pa.Array) -> bytes:
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tobytes()


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded_text") -> DataFrame:
    """Add the token ids of ``text`` (an array of integers) and the text that they decode to."""
    kept = others(docs.columns, (ids, decoded))
    docs = docs.select(*[docs[f"`{c}`"] for c in kept])
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_bpe(path)
        for batch in batches:
            for part in pieces(batch, text):
                made, back = codec.encode(part.column(text).to_pylist())
                sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
                flat = pa.array(np.frombuffer(b"".join(made), "<i4"))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat), pa.array(back, pa.string())], names=[*kept, ids, decoded])

    return docs.mapInArrow(run, schema)
