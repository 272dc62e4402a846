"""Token counts of whole texts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import spread

#: Most chunks whose counts a worker keeps; the store is emptied when full.
CACHED, CACHED_CHARS = 500_000, 64
#: Most new pre-tokens that are merged at a time.
MERGED_BYTES = 4_000_000
NONE = np.int64(2**40)
#: The pre-token pattern of the byte-level vocabularies, with white space as Unicode has it.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_MEETS = regex.compile(r" \p{White_Space}|[^\P{White_Space} ] ")
_CHUNKS = regex.compile(r" ?\P{White_Space}+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class Merger:
    """The merges of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab = said["model"]["vocab"]
        self.special = [t["content"] for t in said["added_tokens"]]
        self.letters = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pattern = regex.compile(PRETOKENS)
        self.known: dict[str, int] = {}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left in each token: all tokens are held in one flat array, and in each round every token applies
        its pair of lowest rank, at all its places from left to right."""
        left = np.zeros(len(tokens), np.int64)
        size = np.array([len(t) for t in tokens], np.int64)
        sym = self.letters[np.frombuffer(b"".join(tokens), np.uint8)]
        own = np.repeat(np.arange(len(tokens)), size)
        rank = np.full(len(sym), NONE)
        inner = np.flatnonzero(own[:-1] == own[1:])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            over = least == NONE
            if over.any():
                left[own[first[over]]] = length[over]
                live = np.repeat(~over, length)
                sym, own, rank = sym[live], own[live], rank[live]
                length, least = length[~over], least[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            run = np.r_[True, np.diff(hit) != 1]  # in a run of places that overlap, every second one counts
            step = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[step % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            at = (np.cumsum(stays) - 1)[hit]
            sym, own, rank = sym[stays], own[stays], rank[stays]
            touched = np.r_[at, at[at > 0] - 1]
            rank[touched] = NONE
            touched = touched[touched < len(sym) - 1]
            touched = touched[own[touched] == own[touched + 1]]
            rank[touched] = self.ranks(sym[touched], sym[touched + 1])
        return left

    def learn(self, chunks: list[str]) -> dict[str, int]:
        """Counts of chunks: each is cut into pre-tokens, and each new pre-token is merged once."""
        parts = list(map(self.pattern.findall, chunks))
        new = list(set(itertools.chain.from_iterable(parts)))
        seen: dict[str, int] = {}
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and size <= MERGED_BYTES:
                size, end = size + len(new[end]), end + 1
            seen.update(zip(new[at:end], self.merge([t.encode() for t in new[at:end]]).tolist(), strict=True))
            at = end
        return {c: sum(map(seen.__getitem__, found)) for c, found in zip(chunks, parts, strict=True)}

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; strings of special tokens count as one token each."""
        cut = [chunks_of(t, self.cut) for t in texts]
        every = set().union(*(chunks for chunks, _ in cut))
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known, new = {}, every
        self.known.update(self.learn(list(new)))
        count = self.known.__getitem__
        out = [special + sum(map(count, chunks)) for chunks, special in cut]
        for c in new:
            if len(c) > CACHED_CHARS:
                del self.known[c]
        return out


def chunks_of(text: str, cut: regex.Pattern | None) -> tuple[list[str], int]:
    """Pieces between which no pre-token reaches, and the number of special strings."""
    pieces = cut.split(text) if cut else [text]
    out: list[str] = []
    for p in pieces:
        if not p:
            continue
        if _MEETS.search(p):
            out += _CHUNKS.findall(p)
        else:
            first, *rest = p.split(" ")
            out += [first] if first else []
            out += [" " + r for r in rest]
    return out, len(pieces) - 1


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens); null and repeated keys are passed through row by row; texts of any
    length are counted whole; other columns (also those named like the result's) are left out; an empty table gives an
    empty one. ``path`` names a tokenizers .json file of a byte-level BPE on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = pa.array(m.counts(texts), pa.int64())
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, n, pa.array(np.asarray(n) > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[key]
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
