"""SentencePiece encoding and decoding by vectorised merge rounds.

The pieces and scores of a BPE model with byte fallback are read from its file; the
merging is done here.  The new words of a block of texts lie in one flat array of
symbols.  A round finds the least pair rank of every word at once, merges all leftmost
pairs of that rank together and compacts the array, until no pair of a word is a piece.

Two cases keep the order of the library, which merges one best pair at a time:

* where a merged piece may open a pair of no greater rank (``the`` after a lone word
  mark), a round merges the first such pair of a word only;
* words of more than ``LONG`` symbols (texts without blanks) take the least rank within a window
  of twice the longest piece on either side: no merge further away can reach a pair
  before it is due, and so even a megabyte without blanks takes a bounded number of rounds.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blocks

MARK = "▁"
NONE = np.int64(1 << 40)
LONG = 64
#: Texts that are encoded together.
BLOCK_BYTES = 1 << 19


def _each_byte(e: UnicodeDecodeError):
    """Every byte that is no part of a character becomes one replacement character."""
    return "�", e.start + 1


codecs.register_error("sensorloom.each_byte", _each_byte)


def _least_ahead(r: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` items after each one (a power of two)."""
    m = np.append(r[1:], NONE)
    k = 1
    while k < width:
        m[:-k] = np.minimum(m[:-k], m[k:]) if k < len(m) else m[:-k]
        k *= 2
    return m


class Vocabulary:
    """Pieces of a model file as arrays: merges by pair of symbols, and the bytes of each piece.

    A symbol is a piece's id; characters that are in pieces but no piece of their own come after
    the ids, and any other character ``c`` is ``-1 - c``."""

    def __init__(self, path: str, max_words: int = 150_000):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bos, self.eos, self.size = sp.bos_id(), sp.eos_id(), n
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.id_of = {names[i]: i for i in normal}
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        symbol = dict(self.id_of)
        for c in sorted({c for i in normal for c in names[i]} - symbol.keys()):
            symbol[c] = n + len(symbol) - len(self.id_of)
        self.n_symbols = n + len(symbol) - len(self.id_of)
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs, into = [], []
        self.early = np.zeros(n, bool)  # pieces that may open a pair of no greater rank
        for i in normal:
            s = names[i]
            for k in range(1, len(s)):
                a, b = symbol.get(s[:k]), symbol.get(s[k:])
                if a is not None and b is not None:
                    pairs.append(a * self.n_symbols + b)
                    into.append(i)
                    for part in (s[:k], s[k:]):
                        if len(part) > 1 and rank[i] <= rank[self.id_of[part]]:
                            self.early[self.id_of[part]] = True
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.into = np.array(pairs, np.int64)[order], np.array(into, np.int64)[order]
        self.rank = rank[self.into].astype(np.int64)
        longest = max((len(names[i]) for i in normal), default=1)
        self.window = 1 << (2 * longest - 1).bit_length()
        self.bytes = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_id):
            self.bytes[i] = bytes([b])
        self.marked = np.zeros(n, bool)
        self.marked[[i for i in normal if names[i].startswith(MARK)]] = True
        self.piece_data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.piece_size = np.array([len(b) for b in self.bytes], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self._runs_of_blanks(names, normal, rank)
        apart = "".join(c for c in "\n\t\r" if self.of_char[ord(c)] < 0)  # in no piece: words end there
        self.word = re.compile(f"[{apart}]+|(?: +[^ {apart}]|[^ {apart}])[^ {apart}]*| +" if apart else " *[^ ]+| +")
        self.words: dict[str, bytes] = {}
        self.max_words = max_words
        probe = ["", " ", "a  b", "x▁y", "ﬁ ①\n\tz ", "the theory", " " * 40 + "end"]
        if [list(self._ids(t)) for t in probe] != [sp.encode(t) for t in probe]:
            raise ValueError("not a BPE model with byte fallback, a mark before the text and no rewriting of texts")

    def _runs_of_blanks(self, names, normal, rank) -> None:
        """Pieces of marks alone, whose merges are alike in rank and come after all others."""
        runs = {len(names[i]): i for i in normal if set(names[i]) == {MARK}}
        last = [rank[i] for k, i in runs.items() if k > 1]
        other = max((rank[i] for i in normal if len(names[i]) > 1 and set(names[i]) != {MARK}), default=-1)
        inner = any(MARK in names[i].lstrip(MARK) or MARK * 2 in names[i] and set(names[i]) != {MARK} for i in normal)
        if inner or 1 not in runs or len(set(last)) > 1 or last and last[0] <= other:
            raise ValueError("pieces with a mark inside, or runs of marks that merge before other pieces")
        self.blanks = runs

    def _blank_run(self, n: int) -> list[int]:
        """Ids of ``n`` marks: of pairs alike in rank the leftmost merges first."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in self.blanks:
                done[-2:] = [done[-2] + done[-1]]
        return [self.blanks[k] for k in done]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of pairs of symbols; rank NONE where they are no piece."""
        key = np.where((left < 0) | (right < 0), -1, left * self.n_symbols + right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = self.pairs[at] == key
        return np.where(found, self.rank[at], NONE), self.into[at]

    def _rounds(self, sym: np.ndarray, size: np.ndarray, windowed: bool) -> tuple[np.ndarray, np.ndarray]:
        """Merge the words that lie one after the other in ``sym``; (symbols, symbols of each word)."""
        out_sym, out_word = [], []
        name = np.arange(len(size))  # of the words still open
        word = np.repeat(name, size)
        rank, into = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same], into[same] = self._look_up(sym[same], sym[same + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            closed = low == NONE
            if closed.any():
                gone = np.repeat(closed, np.diff(np.append(first, len(sym))))
                out_sym.append(sym[gone])
                out_word.append(word[gone])
                sym, word, rank, into = sym[~gone], word[~gone], rank[~gone], into[~gone]
                if not len(sym):
                    break
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                low = low[~closed]
            if windowed:
                hit = self._due(sym, word, rank, into)
            else:
                hit = np.flatnonzero(rank == np.repeat(low, np.diff(np.append(first, len(sym)))))
                opens = np.append(True, np.diff(hit) > 1)
                run = np.maximum.accumulate(np.where(opens, hit, 0))
                leader = np.append(True, word[hit[1:]] != word[hit[:-1]])
                hit = hit[np.where(self.early[into[hit]], leader, (hit - run) % 2 == 0)]
            sym[hit] = into[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # their places after the compaction
            sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
            fresh = np.unique(np.concatenate([hit, hit[hit > 0] - 1]))
            rank[fresh] = NONE
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh], into[fresh] = self._look_up(sym[fresh], sym[fresh + 1])
        word = np.concatenate(out_word) if out_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return (np.concatenate(out_sym) if out_sym else sym)[order], np.bincount(word, minlength=len(size))

    def _due(self, sym, word, rank, into) -> np.ndarray:
        """Pairs of long words that nothing can reach before they merge: none of less rank lies within the window.
        Of a run of overlapping pairs of one rank every other one merges; behind a pair that opens
        one of no greater rank, its window waits."""
        place = np.arange(len(rank))
        safe = (rank < NONE) & (np.minimum(_least_ahead(rank, self.window), _least_ahead(rank[::-1], self.window)[::-1]) >= rank)
        run = np.maximum.accumulate(np.where(np.append(True, rank[1:] != rank[:-1]), place, 0))
        unsafe = np.cumsum(~safe)
        hit = np.flatnonzero(safe & (unsafe == (unsafe - ~safe)[run]) & ((place - run) % 2 == 0))
        early = hit[self.early[into[hit]]]
        if len(early):
            piece, merged = into[early], sym.copy()
            merged[hit + 1] = into[hit]  # what then stands before the next symbol
            after, before = np.minimum(early + 2, len(sym) - 1), np.maximum(early - 1, 0)
            opens = (word[after] == word[early]) & (after > early + 1) & (self._look_up(piece, sym[after])[0] <= rank[early])
            opens |= (word[before] == word[early]) & (before < early) & (self._look_up(merged[before], piece)[0] <= rank[early])
            first = early[opens]
            if len(first):
                k = np.searchsorted(first, hit) - 1
                hit = hit[(k < 0) | (hit - first[np.maximum(k, 0)] > self.window)]
        return hit

    def _with_bytes(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: a character that is no piece becomes the pieces of its UTF-8 bytes."""
        char = self.char_of(sym)
        width = np.where(char < 0, 1, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF))
        at = np.repeat(np.cumsum(width) - width, width)
        k = np.arange(len(at)) - at
        char, n = np.repeat(char, width), np.repeat(width, width)
        part = char >> (6 * (n - 1 - k))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
        byte = np.where(k == 0, lead | part, 0x80 | (part & 0x3F))
        ids = np.where(char < 0, np.repeat(sym, width), self.byte_id[np.where(char < 0, 0, byte)])
        bounds = np.append(0, np.cumsum(size))
        total = np.append(0, np.cumsum(width))
        return ids, np.diff(total[bounds])

    def char_of(self, sym: np.ndarray) -> np.ndarray:
        """The character of symbols that have no id, -1 for the others."""
        if not hasattr(self, "spare"):
            of = np.flatnonzero(self.of_char >= self.size)
            self.spare = np.zeros(self.n_symbols - self.size, np.int64)
            self.spare[self.of_char[of] - self.size] = of
        out = np.where(sym < 0, -1 - sym, -1)
        other = sym >= self.size
        out[other] = self.spare[sym[other] - self.size]
        return out

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, by merge rounds over all of them together."""
        wide = [w for w in words if w.startswith("  ")]
        if wide:
            cores = {" " + w.lstrip(" ") for w in wide} - {" "}
            self._learn([w for w in cores if w not in self.words])
            for w in wide:
                core = w.lstrip(" ")
                n, rest = len(w) - len(core), np.frombuffer(self.words[" " + core], "<u4") if core else np.zeros(0, "<u4")
                if not core or rest[0] == self.blanks[1]:
                    rest = rest[1:]  # the mark before the word stayed alone: one of the run
                else:
                    n -= 1
                self.words[w] = np.append(self._blank_run(n), rest).astype("<u4").tobytes()
            words = [w for w in words if not w.startswith("  ")]
        for windowed in (False, True):
            part = [w for w in words if (len(w) > LONG) == windowed]
            if not part:
                continue
            chars = np.frombuffer("".join(part).replace(" ", MARK).encode("utf-32-le"), "<u4")
            size = np.array([len(w) for w in part])
            ids, n = self._with_bytes(*self._rounds(self.of_char[chars], size, windowed))
            data, end = ids.astype("<u4").tobytes(), (np.cumsum(n) * 4).tolist()
            self.words.update(zip(part, (data[a:b] for a, b in zip([0, *end], end))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian uint32 bytes) of each text, without begin and end."""
        split = [self.word.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = {w for words in split for w in words} - self.words.keys()
        if len(self.words) + len(new) > self.max_words:
            self.words = {}
            new = {w for words in split for w in words}
        self._learn(list(new))
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode([text])[0], "<u4")

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """Texts of sequences that lie one after the other in ``ids``."""
        ids = ids.astype(np.int64)
        if len(ids) and ids.max() >= self.size:
            raise ValueError(f"id {ids.max()} is not in the vocabulary")
        width = self.piece_size[ids]
        begin = np.cumsum(width) - width
        place = np.arange(int(width.sum())) - np.repeat(begin, width) + np.repeat(self.piece_at[ids], width)
        data = self.piece_data[place].tobytes()
        end = np.append(0, np.cumsum(size))
        byte_at = np.append(begin, len(data))[end]
        shown = np.flatnonzero(width > 0)  # the first piece with text loses the mark before the text
        first = np.append(shown, len(ids))[np.searchsorted(shown, end[:-1])]
        strip = np.zeros(len(size), bool)
        inside = first < end[1:]
        strip[inside] = self.marked[ids[first[inside]]]
        return [data[a + s:b].decode("utf-8", "sensorloom.each_byte") for a, b, s in zip(byte_at[:-1].tolist(), byte_at[1:].tolist(), strip.tolist())]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_ids(text: Column, model_path: str, *, begin: bool = True, end: bool = True) -> Column:
    """Binary column: the text's ids as little-endian uint32, with the ids of begin and end.  Null counts as empty."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voc = vocabulary(model_path)
        opening = np.array([voc.bos] * begin, "<u4").tobytes()
        closing = np.array([voc.eos] * end, "<u4").tobytes()
        for texts in batches:
            out = []
            for _, part in blocks(texts, BLOCK_BYTES):
                out += [opening + ids + closing for ids in voc.encode(part.to_pylist())]
            yield pa.array(out, pa.binary())
    return F.arrow_udf(run, "binary")(text)


def decode_ids(ids: Column, model_path: str) -> Column:
    """String column: the text of binary little-endian uint32 ids, as the library's ``decode``.  Null
    counts as no ids; an id outside the vocabulary is an error."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voc = vocabulary(model_path)
        for arr in batches:
            out = []
            for _, part in blocks(arr.fill_null(b"").cast(pa.large_binary()), BLOCK_BYTES):
                rows = part.to_pylist()
                out += voc.decode(np.frombuffer(b"".join(rows), "<u4"), np.array([len(r) // 4 for r in rows], np.int64))
            yield pa.array(out, pa.string())
    return F.arrow_udf(run, "string")(ids)


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian uint32, with begin and end) of every whole text, and with ``decode`` the text
    ``decoded`` from these ids.

    A null or empty text has begin and end alone.  Null ids and repeated rows are returned
    as they are; an empty table gives no rows; other columns are ignored.  No shuffle: each
    task holds the words of one block of texts, and a cache of bounded size."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_path)
        opening, closing = (np.array([i], "<u4").tobytes() for i in (voc.bos, voc.eos))
        for batch in batches:
            for at, part in blocks(batch.column(1), BLOCK_BYTES):
                ids = [opening + x + closing for x in voc.encode(part.to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                cols = {"doc_id": batch.column(0).slice(at, len(part)), "n_tokens": pa.array(n), "ids": pa.array(ids, pa.binary())}
                if decode:
                    cols["decoded"] = pa.array(voc.decode(np.frombuffer(b"".join(ids), "<u4"), n), pa.string())
                yield pa.RecordBatch.from_pydict(cols)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + (", decoded string" if decode else ""))
