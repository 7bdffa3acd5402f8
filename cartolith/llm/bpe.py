"""BPE encoding and decoding by batched numpy merge rounds.

The distinct pieces of a batch of texts are laid out as symbols in one flat array. In each round every
piece merges its lowest-rank pair, wherever it occurs; ranks are found by binary search over the sorted
pair keys, and only for pairs that the last round changed. As a merged symbol's own pairs rank after the
pair that made it, merging all places of the lowest pair at once equals merging one at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import as_row, of_row

_WS = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pattern that byte-level BPE vocabularies of this family split text by, with \s spelt out.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Pieces remembered by a worker, and bytes of text that are encoded at once.
REMEMBERED, AT_ONCE = 250_000, 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of ranges one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        token = [b""] * size
        for text, i in vocab.items():
            token[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        for text, i in self.special.items():
            token[i] = text.encode()
        self.sizes = np.array([len(t) for t in token], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(token), np.uint8)
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.append(np.array([vocab[a + b] for a, b in pairs], np.int64), -1)
        self.none = len(pairs)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.piece_sizes = np.zeros(1024, np.int64)
        self.piece_starts = np.zeros(1024, np.int64)
        self.piece_ids = np.zeros(4096, np.int32)
        self.used = 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], self.none)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(symbol), self.none)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        done_symbol, done_owner = [], []
        while len(symbol):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
            over = low == self.none
            if over.any():
                done_symbol.append(symbol[over])
                done_owner.append(owner[over])
                symbol, owner, rank, low = (x[~over] for x in (symbol, owner, rank, low))
                if not len(symbol):
                    break
            hit = rank == low
            at = np.flatnonzero(hit)
            # neighbouring hits are one symbol repeated: every second of a run is merged
            fresh = np.append(True, np.diff(at) != 1)
            begin = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            at = at[(at - begin) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            stale = np.zeros(len(symbol), bool)
            stale[at] = True
            symbol, owner, rank, stale = symbol[keep], owner[keep], rank[keep], stale[keep]
            stale[:-1] |= stale[1:]
            stale = np.flatnonzero(stale)
            rank[stale] = self.none
            stale = stale[stale < len(symbol) - 1]
            stale = stale[owner[stale] == owner[stale + 1]]
            rank[stale] = self.ranks(symbol[stale], symbol[stale + 1])
        symbol, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_symbol, done_owner))
        order = np.argsort(owner, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(owner, minlength=len(pieces))

    def _learn(self, new: list[str]) -> None:
        ids, sizes = self.merge([p.encode() for p in new])
        n, total = len(self.known), self.used + len(ids)
        while len(self.piece_sizes) < n:
            self.piece_sizes, self.piece_starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.piece_sizes, self.piece_starts))
        while len(self.piece_ids) < total:
            self.piece_ids = np.concatenate([self.piece_ids, np.zeros_like(self.piece_ids)])
        self.piece_sizes[n - len(new) : n] = sizes
        self.piece_starts[n - len(new) : n] = self.used + np.cumsum(sizes) - sizes
        self.piece_ids[self.used : total] = ids
        self.used = total

    def _encode(self, texts: list[str], special: bool) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        known, new, index, plain = self.known, [], [], []

        def pieces(text: str) -> np.ndarray:
            found = PIECE.findall(text)
            fresh = set(found).difference(known)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            new.extend(fresh)
            return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

        for text in texts:
            if special and self.split and any(s in text for s in self.special):
                index.append([self.special[s] if s in self.special else pieces(s) for s in self.split.split(text) if s])
            else:
                index.append([pieces(text)])
        if new:
            self._learn(new)
        for parts in index:
            ids = [np.array([p], np.int32) if isinstance(p, int) else self.piece_ids[_spread(self.piece_starts[p], self.piece_sizes[p])] for p in parts]
            plain.append(ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else np.empty(0, np.int32))
        return plain

    def encode(self, texts: list[str | None], special: bool = True) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty. special: special tokens' strings in a text become their ids."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from self._encode(held, special)
                held, size = [], 0
        yield from self._encode(held, special)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        return self.flat[_spread(self.starts[ids], self.sizes[ids])].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each worker process and file."""
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, special: bool = True, decoded: bool = False) -> DataFrame:
    """docs' columns, with ids array<int> and n_tokens long, and the text decoded from ids if asked for.

    A null text counts as empty and has no ids. Columns of docs named ids, n_tokens or decoded are replaced, all
    others stay, whatever their names. Every row stays; a text of any length is encoded whole."""
    path = path or default_path()
    names = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens", "decoded")]
    rows = docs.select(as_row(docs, names), F.col("text").cast("string").alias("text"))
    added = ["ids", "n_tokens", *(["decoded"] if decoded else [])]
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), *([T.StructField("decoded", T.StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                all_ids = list(own.encode(part.column("text").to_pylist(), special))
                sizes = np.array([len(x) for x in all_ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(all_ids).astype(np.int32)))
                cols = [part.column("row"), lists, pa.array(sizes), *([pa.array([own.decode(x) for x in all_ids], pa.string())] if decoded else [])]
                yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    return rows.mapInArrow(run, schema).select(*of_row(names), *added)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows' columns, with the text of each row's ids as decoded; null ids give null."""
    path = path or default_path()
    names = [c for c in rows.columns if c.lower() != "decoded"]
    packed = rows.select(as_row(rows, names), F.col("ids").cast("array<int>").alias("ids"))
    schema = T.StructType([packed.schema["row"], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = [None if not x.is_valid else own.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], schema.fieldNames())

    return packed.mapInArrow(run, schema).select(*of_row(names), "decoded")
