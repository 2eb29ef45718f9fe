"""Hierarchical multi-length packing into token sequences.

Documents longer than the longest window are cut into whole windows; the rest
of each goes to the smallest tier (context size) that holds it.  Tiers are
packed from the longest down: each piece opens a window of its tier, whose gap is
filled by the largest pieces of shorter tiers that fit, and at last by cutting
one.  Since window sizes are powers of two, a filled window of any tier needs no
padding; what is left at the end of a task is cut into powers of two as well.
Sequences of a tier form step groups of equal token counts.

Tasks pack their own partition: no shuffle, and a pool of bounded size in memory.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks

TIERS = (2048, 1024, 512, 256)
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "window long, step_group long")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int64()), ("step_group", pa.int64())])
WORD_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Spaces other than a blank or a line end, ASCII ones first.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f" + "".join(c for c in map(chr, range(128, 0x3001)) if c.isspace())
#: Words of marks, Latin letters and line ends, which all versions of Unicode class alike.
PLAIN = re.compile(r"[\n!-~\u00C0-\u024F]+")


def odd_spaces(text: str) -> bool:
    """Whether a blank of the text may stand beside another space or at an end."""
    if "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
        return True
    return any(c in text for c in (OTHER_SPACE[:8] if text.isascii() else OTHER_SPACE))


def fast_encoder(tok):
    """The same byte-level BPE by tiktoken, from the same vocabulary; None where its merges are not in the order of their ids."""
    import tiktoken
    spec = json.loads(tok.to_str())
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != ("ByteLevel", False, True):
        return None
    vocab = tok.get_vocab(with_added_tokens=False)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ids = [vocab["".join(m)] for m in pairs]
    if ids != sorted(set(ids)) or len(vocab) != len(ids) + 256:
        return None
    byte_of = {c: b for b, c in enumerate(_byte_letters())}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: that of byte-level BPE
    return tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Encoder:
    """Token ids (little-endian uint32 bytes) of texts, by a byte-level tokenizer file.

    A single blank between two non-spaces always begins a new word of such a
    tokenizer, so texts are encoded word by word, and words seen before come from
    a cache of bounded size.  New words of plain letters go through ``fast_encoder``, which has the
    same ids; texts that hold a special token's string are encoded whole."""

    def __init__(self, path: str, max_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.tok.get_vocab_size() + 1, bool)  # ids whose token begins with a blank
        for token, i in self.tok.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.fast = fast_encoder(self.tok) or self.slow
        self.words: dict[str, bytes] = {}
        self.max_words = max_words

    def slow(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array((self.fast if PLAIN.fullmatch(text) else self.slow)(text), "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of ' ' + word for each word: plain words together, parted where a token opens with a blank."""
        plain = PLAIN.fullmatch
        odd = [w for w in words if not plain(w)]
        words = [w for w in words if plain(w)]
        for i in range(0, len(words), 1000):
            part = words[i:i + 1000]
            ids = np.array(self.fast(" " + " ".join(part)), "<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(part) and at[0] == 0:
                data = ids.tobytes()
                at = (at * 4).tolist()
                self.words.update(zip(part, (data[a:b] for a, b in zip(at, [*at[1:], len(data)]))))
            else:
                odd += part
        for w in odd:
            self.words[w] = np.array(self.slow(" " + w), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            if not t or any(s in t for s in self.special):
                split.append(None)
            else:
                split.append(WORD_GAP.split(t) if odd_spaces(t) else t.split(" "))
        used = set()
        for s in split:
            if s:
                used.update(s[1:])
        if len(self.words) + len(used) > self.max_words:
            self.words = {w: self.words[w] for w in used & self.words.keys()}
        self._learn([w for w in used if w not in self.words])
        get = self.words.__getitem__
        return [np.array(self.slow(t), "<u4").tobytes() if s is None else self.whole(s[0]) + b"".join(map(get, s[1:])) for t, s in zip(texts, split)]


def _cut(piece: tuple, lo: int, hi: int | None) -> tuple:
    """Tokens ``lo`` to ``hi`` of a piece."""
    doc, start, ids, total = piece
    return doc, start + lo, ids[4 * lo:None if hi is None else 4 * hi], total


class Packer:
    """Packs pieces (document, start, ids, tokens of the document); ``out`` gets rows."""

    def __init__(self, first_id: int, tiers: tuple[int, ...], group_tokens: int, pool_tokens: int):
        self.tiers, self.group_tokens, self.pool_tokens = tiers, group_tokens, pool_tokens
        self.next_id = self.first_id = first_id
        self.made: dict[int, int] = {}
        self.pool: list[tuple] = []
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        total, top = len(ids) // 4, self.tiers[0]
        start = 0
        while total - start >= top:
            self._emit([(doc, start, ids[4 * start:4 * (start + top)], total)])
            start += top
        if start < total:
            self.pool.append((doc, start, ids[4 * start:], total))
            self.held += total - start
            if self.held >= self.pool_tokens:
                self._pack(last=False)

    def _emit(self, pieces: list[tuple]) -> None:
        size = sum(len(p[2]) // 4 for p in pieces)
        nth = self.made.get(size, 0)
        self.made[size] = nth + 1
        group = (self.first_id << 1) + size.bit_length() * (1 << 32) + nth // max(1, self.group_tokens // size)
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids) // 4, ids, total, self.next_id, at, size, group))
            at += len(ids) // 4
        self.next_id += 1

    def _pack(self, last: bool) -> None:
        # by length; equal ones in order of arrival, never compared further
        pool = sorted(((len(p[2]) // 4, i, p) for i, p in enumerate(self.pool)), key=lambda x: x[:2])
        serial, total = len(pool), self.held
        left = []

        def put_back(n: int, piece: tuple) -> None:
            nonlocal serial
            insort(pool, (n, serial, piece), key=lambda x: x[:2])
            serial += 1

        for tier in self.tiers:
            short = tier // 2 if tier > self.tiers[-1] else 0
            while pool and pool[-1][0] > short and total >= tier:
                size, _, piece = pool.pop()
                if size > tier:  # left over from a longer tier
                    put_back(size - tier, _cut(piece, tier, None))
                    size, piece = tier, _cut(piece, 0, tier)
                window, gap = [piece], tier - size
                while gap:
                    i = bisect_right(pool, gap, key=lambda x: x[0])
                    if i:  # the largest that fits
                        n, _, p = pool.pop(i - 1)
                    else:  # cut the shortest
                        n, _, p = pool.pop(0)
                        put_back(n - gap, _cut(p, gap, None))
                        n, p = gap, _cut(p, 0, gap)
                    window.append(p)
                    gap -= n
                self._emit(window)
                total -= tier
        left += [x[2] for x in pool]
        self.pool, self.held = left, sum(len(p[2]) // 4 for p in left)
        if last and self.held:
            self._powers()

    def _powers(self) -> None:
        """Cut what is left into windows of decreasing powers of two."""
        rest = list(reversed(self.pool))
        while self.held:
            size = min(self.tiers[0], 1 << (self.held.bit_length() - 1))
            window, need = [], size
            while need:
                doc, start, ids, total = rest.pop()
                n = min(need, len(ids) // 4)
                window.append((doc, start, ids[:4 * n], total))
                if 4 * n < len(ids):
                    rest.append((doc, start + n, ids[4 * n:], total))
                need -= n
            self._emit(window)
            self.held -= size
        self.pool = []

    def finish(self) -> None:
        self._pack(last=True)

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) if self.out else [[]] * 9
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _packer(path: str, tiers: tuple[int, ...], end_id: int, group_tokens: int, pool_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, tiers, group_tokens, pool_tokens)
        for batch in batches:
            for at, texts in blocks(batch.column(1), 4 << 20):
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                for doc, encoded in zip(ids, encoder.encode(texts.to_pylist())):
                    packer.add(doc, encoded + end)
                    if len(packer.out) >= 2000:
                        yield packer.take()
        packer.finish()
        yield packer.take()
    return run


def pack(docs: DataFrame, tokenizer_path: str, *, tiers: tuple[int, ...] = TIERS, end_id: int = 1, group_tokens: int = 1 << 16,
         pool_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document in their sequences: ``doc_id, start, length, ids``
    (little-endian uint32), ``doc_tokens, sequence_id, offset, window`` (tokens of the sequence, a power of
    two) and ``step_group`` (sequences of one window size with ``group_tokens`` tokens together).

    ``tiers`` are descending powers of two.  Each document is its tokens and ``end_id``; a null or empty text is
    ``end_id`` alone.  Repeated rows are packed as often as they occur; a null id is kept; an empty table gives
    no rows; other columns are ignored.  The result follows the partitioning of
    ``docs``: read a written table, and a lost task is packed again alike."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(_packer(tokenizer_path, tiers, end_id, group_tokens, pool_tokens), PIECES)
