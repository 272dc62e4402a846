"""Packing of token sequences into windows: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import bisect
import itertools
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import spread

WINDOW, END_ID = 2048, 1
#: Lengths are fitted in classes of GRAIN tokens; a combination has at most DEPTH pieces.
GRAIN, DEPTH = 64, 4
#: Windows that one piece left over may have to fill a gap of, on average; combinations are given up until it is so.
CUTS, STRIDE = 4, 7919
#: Tokens that a task packs at a time; its memory is in proportion.
BUFFER_TOKENS = 4_000_000
#: Most words whose ids a worker keeps, and the longest such word; the store is emptied when full.
CACHED, CACHED_CHARS = 500_000, 64
SCHEMA = "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def combinations(classes: int, depth: int) -> np.ndarray:
    """All multisets of at most ``depth`` classes (1 to ``classes``) whose sum is ``classes``, as columns of counts."""

    def parts(left: int, most: int, room: int) -> Iterator[list[int]]:
        if left == 0:
            yield []
        elif room:
            for c in range(min(left, most), 0, -1):
                for rest in parts(left - c, c, room - 1):
                    yield [c, *rest]

    found = list(parts(classes, classes, depth))
    out = np.zeros((classes, len(found)))
    for j, p in enumerate(found):
        for c in p:
            out[c - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, by growing and shrinking the set of positive entries."""
    x, positive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[positive] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= slack:
            break
        positive[j] = True
        while True:
            s = np.zeros_like(x)
            s[positive] = np.linalg.lstsq(a[:, positive], b, rcond=None)[0]
            low = positive & (s <= 0)
            if not low.any():
                x = s
                break
            move = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + move * (s - x)
            positive &= x > 1e-12
            x[~positive] = 0
            if not positive.any():
                break
    return x


#: The pre-tokens of the word-level vocabulary, whose normal form of Latin-1 text is its lower case.
LATIN = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^ \t-\r\x85\xa00-9²³¹¼½¾a-zªµºß-öø-ÿ]+")
#: Words of Latin-1 letters that are one pre-token each; other letters may stand beside signs and go in alone.
SINGLE = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)")
_COMBOS = combinations(WINDOW // GRAIN, DEPTH)


def plan(lengths: list[int]) -> tuple[list[tuple[int, int, int]], int]:
    """Pieces (document, start, length) in the order in which they fill windows, for documents of these lengths.

    Whole windows are cut off the front of long documents. The rests are fitted: combinations are repeated as the
    rounded solution says, and each window's gap is filled greedily with pieces that no combination took: the longest
    that fits whole, and where none fits a cut of one of them in turn, so cuts spread over documents. What is left
    follows as one stream. All windows are full but those at the end.
    """
    out = [(d, at, WINDOW) for d, n in enumerate(lengths) for at in range(0, n - WINDOW + 1, WINDOW)]
    rests = [(n % WINDOW, d, n - n % WINDOW) for d, n in enumerate(lengths) if n % WINDOW]
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(WINDOW // GRAIN)]
    for r in rests:
        bins[(r[0] - 1) // GRAIN].append(r)
    repeats = nnls(_COMBOS, np.array([len(b) for b in bins], float)) if rests else np.zeros(_COMBOS.shape[1])
    groups: list[list[tuple[int, int, int]]] = []
    for j in np.argsort(-repeats, kind="stable"):
        if (times := round(repeats[j])) < 1:
            break
        need = [(int(c), int(k)) for c, k in enumerate(_COMBOS[:, j]) if k]
        times = min([times, *(len(bins[c]) // k for c, k in need)])
        for _ in range(times):
            groups.append([bins[c].pop() for c, k in need for _ in range(k)])
    spare = sorted(r for b in bins for r in b)
    done = 0
    while done < len(groups):
        gap = WINDOW - sum(p[0] for p in groups[done])
        while gap and (spare or len(groups) > done + 1):
            if len(spare) * CUTS < len(groups) - done - 1 or not spare:
                for piece in groups.pop():
                    bisect.insort(spare, piece)
                continue
            fits = bisect.bisect_right(spare, (gap, math.inf))
            n, d, at = spare.pop(fits - 1 if fits else len(out) * STRIDE % len(spare))
            groups[done].append((min(n, gap), d, at))
            if n > gap:
                bisect.insort(spare, (n - gap, d, at + gap))
            gap -= min(n, gap)
        if gap:
            spare += groups.pop()
            break
        out += [(d, at, n) for n, d, at in groups[done]]
        done += 1
    return out + [(d, at, n) for n, d, at in reversed(spare)], len(lengths)


def lay(pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset): pieces end to end in windows; the last, if short, is split into
    windows whose sizes are powers of two, which need no padding."""
    total = sum(p[2] for p in pieces)
    full, tail = divmod(total, WINDOW)
    sizes = itertools.chain(itertools.repeat(WINDOW, full), (1 << i for i in range(WINDOW.bit_length() - 2, -1, -1) if tail >> i & 1))
    window, offset, room = 0, 0, next(sizes, 0)
    for d, at, n in pieces:
        while n:
            take = min(n, room - offset)
            yield d, at, take, window, offset
            at, n, offset = at + take, n - take, offset + take
            if offset == room:
                window, offset, room = window + 1, 0, next(sizes, 0)


class WordIds:
    """Token ids by the word-level vocabulary's file, whose normalizer and splits never join text across a space or a
    line end, so pieces of texts are looked up and only new ones go to the library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def ask(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words from the library. Single pre-tokens go in together, since each one's last id ends a word."""
        out: dict[str, bytes] = {}
        single = [w for w in words if SINGLE.fullmatch(w)]
        for at in range(0, len(single), 1000):
            some = single[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                out[w] = raw[start:end]
                start = end
        rest = [w for w in words if w not in out]
        for at in range(0, len(rest), 1000):
            found = self.tokenizer.encode_batch_fast(rest[at : at + 1000], add_special_tokens=False)
            out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest[at : at + 1000], found, strict=True))
        return out

    def pieces(self, text: str) -> list[str]:
        """Strings that the library would treat alone as it does in the text: pre-tokens, or words where a text has
        characters for which only the library knows the normal form."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        return LATIN.findall(text.lower()) if "<|" not in text else text.replace("\n", " ").split(" ")

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit little-endian integers."""
        cut = list(map(self.pieces, texts))
        every = set().union(*cut)
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known, new = {}, every
        self.known.update(self.ask(list(new)))
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for p in new:
            if len(p) > CACHED_CHARS:
                del self.known[p]
        return out


_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: key, start, length, doc_tokens, sequence_id, offset and the piece's ids.

    Each document's ids are followed by id 1; a null text counts as empty, so it is the id 1 alone. Each task packs
    what it reads, a buffer of documents at a time, so nothing is shuffled and a lost task is simply run again:
    sequence ids hold the task's number. Repeated rows and null keys are packed as rows of their own; texts of any
    length are read whole, other columns (also those named like the result's) are left out, and an empty table gives
    an empty one. A tail of a buffer that fills no window is split into sequences of a power of two, which need no
    padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = word_ids(path), TaskContext.get().partitionId() << 32, 0
        keys: list[pa.Scalar] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            pieces, _ = plan([len(x) // 4 for x in ids])
            rows, size, last = [], 0, -1
            for row in lay(pieces):
                rows.append(row)
                size, last = size + row[2], row[3]
                if size > BUFFER_TOKENS // 4:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)
            made += last + 1
            keys.clear(), ids.clear()
            held = 0

        def batch_of(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            d, start, length, window, offset = map(np.array, zip(*rows, strict=True))
            cut = [ids[i][4 * a : 4 * (a + n)] for i, a, n, *_ in rows]
            own = pa.array(keys, kind_of_key).take(pa.array(d))
            tokens = np.array([len(ids[i]) // 4 for i in d], np.int64)
            return pa.RecordBatch.from_arrays([own, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens), pa.array(window.astype(np.int64) + base + made), pa.array(offset, pa.int64()), pa.array(cut, pa.binary())], names=names)

        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            kind_of_key = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = encode.of([t or "" for t in part.column(1).to_pylist()])
                for k, x in zip(part.column(0).to_pylist(), found, strict=True):
                    keys.append(k)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= BUFFER_TOKENS:
                        yield from flush()
        if ids:
            yield from flush()

    names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, {SCHEMA}")
