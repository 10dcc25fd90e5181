"""BPE encoding and decoding of whole texts.

Encoding: one Aho-Corasick pass over a word finds every vocabulary match; the encoder walks from the left, always trying the
longest match, accepts a token only if the pair with its left neighbour is one that merging would leave apart, and steps back
where no match fits. A bit for each position keeps a failed position from being tried twice, so the work is linear in the
word. The pair test replays the merge order of the two tokens' inner halves and is kept in a table. The result is the exact
merge result. Decoding gathers bytes by an offset table over the joined vocabulary.

Supported files: JSON of the `tokenizers` library with a BPE model whose merges are in rank order, an end-of-word suffix, NFC +
white-space + lower-case normalising and the letters/number/other word split (the file of word_bpe_49k.json).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, worker_state

#: Chunks of text between white space whose ids a worker keeps, in each of two generations: when the younger is full it becomes the
#: older one, and what is met again moves back into the younger.
CACHE_CHUNKS = 450_000
CACHED_CHUNK_CHARS = 64
#: Ids decoded or printed at once.
SLICE = 1 << 16

#: White space as Unicode's White_Space property has it.
_WHITE = r"\t-\r \x85\xa0  -     　"
_CHUNK = regex.compile(f"[^{_WHITE}]+")
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")
#: Python's own split() also cuts at these, which are no white space here.
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")
_END = " "  # stands for the end-of-word suffix; no byte symbol is a space


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Encoder:
    """Encodes and decodes with one vocabulary file's content (JSON text). One lives in each worker process."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        ended = lambda t: t[: -len(suffix)] + _END if t.endswith(suffix) else t
        self.id_of = {ended(t): i for t, i in vocab.items()}
        self.text_of = {i: t for t, i in self.id_of.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = self.id_of[ended(left)], self.id_of[ended(right)]
            c = self.id_of[ended(left + right)]
            self.rank[a, b] = r
            self.merged[a, b] = c
            self.halves.setdefault(c, (a, b))
        self.born = {c: self.rank[h] for c, h in self.halves.items()}  # rank of the merge that makes a token
        self.automaton = ahocorasick.Automaton()
        stable = self._stable_tokens()
        for t, i in self.id_of.items():
            if i in stable:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.length = {i: len(t) for t, i in self.id_of.items()}
        self.shorter = {}  # the longest other token that a token begins with
        for t, i in self.id_of.items():
            head = next((t[:k] for k in range(len(t) - 1, 0, -1) if self.id_of.get(t[:k], -1) in stable), None)
            self.shorter[i] = -1 if head is None else self.id_of[head]
        self.symbols = dict(enumerate(byte_symbols()))
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self._decoded = self._offset_table([names.get(i, "") + " " for i in range(self.size)])
        self._printed = self._offset_table([f"{i} " for i in range(self.size)])

    @staticmethod
    def _offset_table(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [p.encode() for p in parts]
        return np.frombuffer(b"".join(encoded), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in encoded]))).astype(np.int64)

    # -- encoding -------------------------------------------------------------------------------------------------

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves these two neighbours apart: no merge across their border comes before the border is settled."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        r = self.rank.get((a, b))
        return r is None and self._apart(a, b, len(self.rank))

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge across the border of a and b comes before the merges inside them have used the border up.

        The inner merges are undone latest first. A border pair existed until the merge undone last; on the left that merge
        stands at an earlier place and goes first at equal rank, on the right it goes second.
        """
        while True:
            ra, rb = self.born.get(a, -1), self.born.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False

    def _stable_tokens(self) -> set[int]:
        """Tokens whose own text merges to just that token; no others can occur in a result."""
        stable = {i for i in self.id_of.values() if i not in self.halves}
        for c in sorted(self.halves, key=self.born.get):
            a, b = self.halves[c]
            if a in stable and b in stable and self._apart(a, b, self.born[c]):
                stable.add(c)
        return stable

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as byte symbols."""
        text = word + _END
        n = len(text)
        longest, shorter, length, fits = self.automaton.iter_long, self.shorter, self.length, self.fits
        failed: set[int] = set()
        tokens: list[int] = []
        pos, left = 0, -1
        token = next(longest(text), (0, -1))[1]
        while pos < n:
            while token >= 0:
                if not failed or pos + length[token] not in failed:
                    if left < 0:
                        break
                    good = fits.get((left, token))
                    if good or good is None and self.compatible(left, token):
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                left = token
                pos += length[token]
                token = next(longest(text, pos), (0, -1))[1] if pos < n else -1
            elif tokens:
                failed.add(pos)
                last = tokens.pop()
                pos -= length[last]
                left = tokens[-1] if tokens else -1
                token = shorter[last]
            else:
                raise ValueError("no encoding: the vocabulary lacks a byte")
        return tokens

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= CACHED_CHUNK_CHARS:
            if len(self.cache) >= CACHE_CHUNKS:
                self.older, self.cache = self.cache, {}
            self.cache[text] = ids
        return ids

    def _word_ids(self, word: str) -> bytes:
        """A normalised word's ids, packed. As a chunk of its own it has the same ids, so both share the cache."""
        known = self.cache.get(word)
        if known is None and (known := self.older.get(word)) is not None:
            self._keep(word, known)
        if known is None:
            symbols = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.symbols)
            known = self._keep(word, array("I", self.encode_word(symbols)).tobytes())
        return known

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids (little-endian unsigned 32-bit) of a text without white space."""
        # most chunks are letters, with one mark behind them at most
        head, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in ".,;:!?" else (chunk, "")
        if head.isalpha() and (head.isascii() or "Σ" not in head and unicodedata.is_normalized("NFC", head)):
            low = head.lower()
            if low.isalpha():
                return self._word_ids(low) + self._word_ids(mark) if mark else self._word_ids(low)
        parts, at, out = [], 0, []
        if "<" in chunk and self._special is not None:
            for m in self._special.finditer(chunk):
                parts += [(chunk[at : m.start()], None), ("", self.special[m[0]])]
                at = m.end()
        for part, special in [*parts, (chunk[at:], None)]:
            if special is not None:
                out.append(array("I", [special]).tobytes())
                continue
            part = unicodedata.normalize("NFC", part)
            part = "".join([c.lower() for c in part]) if "Σ" in part else part.lower()
            out += [self._word_ids(w) for w in _WORD.findall(part)]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit; null counts as empty."""
        if not text:
            return b""
        chunks = _CHUNK.findall(text) if any(c in text for c in _CONTROL) else text.split()
        out = list(map(self.cache.get, chunks))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    c = chunks[i]
                    out[i] = self.cache.get(c) or self._keep(c, self.older.get(c) or self.encode_chunk(c))
        return b"".join(out)

    # -- decoding -------------------------------------------------------------------------------------------------

    @staticmethod
    def _gather(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
        body, offsets = table
        start = offsets[ids]
        length = offsets[ids + 1] - start
        ends = np.cumsum(length)
        shift = np.repeat(start - (ends - length), length)
        shift += np.arange(len(shift))
        return body[shift]

    def _pieces(self, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> Iterator[bytes]:
        ids = ids.astype(np.int64)
        for at in range(0, len(ids), SLICE):
            piece = self._gather(table, ids[at : at + SLICE])
            yield (piece[:-1] if at + SLICE >= len(ids) else piece).tobytes()

    def decode_pieces(self, ids: np.ndarray) -> Iterator[bytes]:
        """The decoded text in UTF-8, in pieces: the tokens' own texts with one space between them (the file has no decoder)."""
        return self._pieces(self._decoded, ids)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.decode_pieces(np.asarray(ids))).decode()

    def print_pieces(self, ids: np.ndarray) -> Iterator[bytes]:
        """Decimal ids with one space between them, in pieces."""
        return self._pieces(self._printed, ids)


def worker_encoder(shared) -> Encoder:
    """The worker process's encoder for a broadcast vocabulary file; it goes when another operator's tasks come."""
    return worker_state("bpe", hash(shared.value), lambda: Encoder(shared.value))


def broadcast_vocabulary(df: DataFrame, path: str):
    """The file is read on the driver and sent once; its size (about 2 MB) does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every document; a null or empty text gives an empty array."""
    shared = broadcast_vocabulary(bounded_batches(docs), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(shared)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                packed = [enc.encode(t.as_py()) for t in part.column(1)]
                lengths = np.array([len(p) // 4 for p in packed], np.int32)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "ids"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, decoded string) from (id, ids); null ids decode to the empty text."""
    shared = broadcast_vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(shared)
        for b in batches:
            out = [enc.decode(np.array(x.as_py() or [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "decoded"])

    src = encoded.select(encoded[id_col].alias("id"), "ids")
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every whole text, decodes the ids, digests both; one pass, no shuffle.

    Null and empty texts give no tokens and the digests of nothing; repeated rows give repeated results.
    """
    shared = broadcast_vocabulary(bounded_batches(docs), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(shared)
        for b in batches:
            counts, printed, decoded = [], [], []
            for t in b.column(1):
                ids = np.frombuffer(enc.encode(t.as_py()), "<u4")
                one, two = hashlib.sha256(), hashlib.sha256()
                for piece in enc.print_pieces(ids):
                    one.update(piece)
                for piece in enc.decode_pieces(ids):
                    two.update(piece)
                counts.append(len(ids))
                printed.append(one.hexdigest())
                decoded.append(two.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(printed), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
