"""Byte-level BPE: pre-tokenisation, a backtracking encoder and an offset-table decoder.

A vocabulary file is read once on the driver and broadcast (its size is that of the
vocabulary, whatever the corpus); the tables below are built from it once per worker.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import kept

#: The split that byte-level vocabularies of this family are trained with (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens that a worker remembers before it starts anew.
CACHE_ENTRIES = 250_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte value in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, fresh = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(fresh)
            fresh += 1
    return out


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class PreTokenizer:
    """Splits text as the tokenizers library does before merging.

    Texts with characters that Python's Unicode tables do not know go to the library itself:
    tables of other years may class them differently.
    """

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        self.spec = spec
        self.specials = {a["content"]: a["id"] for a in parsed["added_tokens"]}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.find = regex.compile(PATTERN).findall
        self.high = re.compile("[\u0558-\U0010ffff]")  # the first unassigned code point and on
        self._library = None

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not self.high.search(text) or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.find(text)
        if self._library is None:
            self._library = library(self.spec)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's string is one of its own."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self._plain(part)
        return out


def library(spec: str):
    """The tokenizers library's own tokenizer, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(spec)
    found.no_truncation()
    found.no_padding()
    return found


class Backtracker:
    """Exact BPE in linear time.

    Tokens are numbered by rank: single bytes, then merges in order. From each position the
    longest token (all matches come from one Aho-Corasick pass) is tried first, then its
    prefixes; it stands if BPE would keep the boundary to the token before it, and where
    nothing stands the last token is taken back. `compatible` answers the boundary question
    and its answers are kept in a table of pairs.
    """

    def __init__(self, spec: str):
        import ahocorasick

        model = json.loads(spec)["model"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        raw = [bytes([b]) for b in range(256)]
        self.ids = [vocab[letters[b]] for b in range(256)]
        where = {t: r for r, t in enumerate(raw)}
        self.halves: list[tuple[int, int]] = [(r, r) for r in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right = (where[bytes(byte_of[c] for c in x)] for x in (a, b))
            whole = raw[left] + raw[right]
            if whole in where:
                raise ValueError(f"two merges make the same token: {a} {b}")
            where[whole] = self.pair[left, right] = len(raw)
            self.halves.append((left, right))
            self.ids.append(vocab[a + b])
            raw.append(whole)
        self.lengths = [len(t) for t in raw]
        self.shorter = [-1] * len(raw)
        for r, t in enumerate(raw):
            for k in range(len(t) - 1, 0, -1):
                if (p := where.get(t[:k])) is not None:
                    self.shorter[r] = p
                    break
        self.tree = ahocorasick.Automaton()
        for r, t in enumerate(raw):
            self.tree.add_word(t.decode("latin-1"), r)
        self.tree.make_automaton()
        self.known: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Would BPE keep a boundary between these two tokens?"""
        key = left << 20 | right
        answer = self.known.get(key)
        if answer is None:
            if len(self.known) > 500_000:
                self.known.clear()
            answer = self.known[key] = self._boundary_stays(left, right)
        return answer

    def _boundary_stays(self, left: int, right: int) -> bool:
        # Undo merges on both sides, latest first. A merge across the boundary wins if its
        # rank is below that of the merges undone so far.
        floor = len(self.halves)
        while True:
            across = self.pair.get((left, right))
            if across is not None and across < floor:
                return False
            if left > right and left >= 256:
                floor, left = left, self.halves[left][1]
            elif right >= 256:
                floor, right = right + 1, self.halves[right][0]
            elif left >= 256:
                floor, left = left, self.halves[left][1]
            else:
                return True

    def ranks(self, text: str) -> list[int]:
        """Ranks of the tokens of bytes given as a latin-1 string."""
        n, lengths = len(text), self.lengths
        longest = [-1] * n
        for end, r in self.tree.iter(text):
            at = end - lengths[r] + 1
            if longest[at] < 0 or lengths[longest[at]] < lengths[r]:
                longest[at] = r
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + lengths[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = self.shorter[token]
        return out

    def encode(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return [self.ids[r] for r in self.ranks(piece.encode("utf-8").decode("latin-1"))]


class Encoder:
    """Ids of whole texts, as little-endian int32 bytes; pre-tokens are encoded once."""

    def __init__(self, spec: str):
        self.splitter = PreTokenizer(spec)
        self.core = Backtracker(spec)
        self._reset()

    def _reset(self) -> None:
        self.cache = {s: array("i", [i]).tobytes() for s, i in self.splitter.specials.items()}

    def encode(self, text: str) -> bytes:
        pieces = self.splitter.split(text)
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            pass
        if len(cache) > CACHE_ENTRIES:
            self._reset()
            cache = self.cache
        encode = self.core.encode
        for p in set(pieces):
            if p not in cache:
                cache[p] = array("i", encode(p)).tobytes()
        return b"".join(map(cache.__getitem__, pieces))


class Decoder:
    """Text of ids through one byte blob and its offsets; unknown ids give nothing."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        entries = {i: t for t, i in parsed["model"]["vocab"].items()} | {a["id"]: a["content"] for a in parsed["added_tokens"]}
        self.top = max(entries, default=-1) + 1
        parts = [b""] * (self.top + 1)
        for i, t in entries.items():
            known = all(c in byte_of for c in t)
            parts[i] = bytes(byte_of[c] for c in t) if known else t.encode("utf-8")
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.where((ids < 0) | (ids >= self.top), self.top, ids)
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(start - (ends - size), size)
        return self.blob[at].tobytes().decode("utf-8", "replace")


def built(kind, spec: str):
    """One table set per worker process and vocabulary."""
    return kept("bytebpe", (kind.__name__, hash(spec)), lambda: kind(spec))


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", slice_rows: int = 256) -> DataFrame:
    """All columns of docs plus `ids_col` array<int>.

    A null text has the ids of an empty one: none. Special strings in a text become their
    own id, as the library does by default. Rows stay rows: repeated ones are each encoded,
    an empty table gives an empty table, and a column already named `ids_col` is replaced.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))
    kept = [c for c in docs.columns if c != ids_col]
    target = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn(ids_col, F.array().cast("array<int>"))
    out_schema = target.schema
    at = kept.index(text_col)

    def work(batches):
        encoder = built(Encoder, spec.value)
        for whole in batches:
            for k in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(k, slice_rows)
                parts = [encoder.encode(x or "") for x in batch.column(at).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(work, out_schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns plus `text_col`, the text of `ids_col`; null ids give an empty text, null
    or unknown entries give nothing, and broken UTF-8 becomes U+FFFD."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))

    @F.pandas_udf("string")
    def text_of(ids):
        decoder = built(Decoder, spec.value)

        def one(x):
            if x is None or not len(x):
                return ""
            x = np.asarray(x)
            return decoder.decode(np.where(np.isnan(x), -1, x).astype(np.int64) if x.dtype.kind == "f" else x.astype(np.int64))

        return ids.map(one)

    return encoded.withColumn(text_col, text_of(F.col(ids_col)))
