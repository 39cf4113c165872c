"""SentencePiece encoding, decoding and counting: one pass over an Aho-Corasick automaton of the pieces.

As the automaton reads a text, its output links name every piece that ends at the current character, longest first.  What
a position keeps of them depends on the kind of vocabulary, which the model file states:

* unigram: Viterbi.  Each piece relaxes the best score at its end; a later candidate must be strictly better, so
  the longest piece wins a tie, as in the library.  Scores are added exactly, where the library rounds to 32 bits.
* merges (BPE): scores are merge ranks there, and the best sum of ranks is not the tokenizer's result.  The same pass keeps
  at each position the last piece of the encoding so far: of the pieces that end there, the one that stands beside
  the last piece before it without merging (the only one that can; pairs are checked once and remembered).

A character in no piece is an unknown: with byte fallback, the byte pieces of its UTF-8.

Pieces hold the space mark only in front, so texts fall into chunks (marks, then other characters) that are solved
once and remembered until the end of the task.  Vocabularies with marks inside pieces are solved as whole texts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import ref

MARK = "\u2581"
#: Chunks that a Python worker remembers in each of two generations (some 200 bytes a chunk).
MEMO = 100_000
#: Longer chunks are solved each time.
MEMO_CHARS = 48
#: Neighbouring pieces of which a worker remembers whether they merge (some 130 bytes a pair).
PAIRS = 200_000
#: An unknown character's unigram score: the lowest score less this.
UNKNOWN_PENALTY = 10
UNIGRAM, BPE = 1, 2


def model_type(raw: bytes) -> int:
    """Field 3 of the trainer settings (field 2) of a serialized model: 1 unigram, 2 merges."""

    def fields(lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(field number, value or start, end) of a protocol buffer message."""
        while lo < hi:
            tag, lo = _varint(raw, lo)
            if tag & 7 == 0:
                value, lo = _varint(raw, lo)
                yield tag >> 3, value, lo
            elif tag & 7 == 2:
                size, lo = _varint(raw, lo)
                yield tag >> 3, lo, lo + size
                lo += size
            else:
                lo += 4 if tag & 7 == 5 else 8

    for number, start, end in fields(0, len(raw)):
        if number == 2:
            return next((value for n, value, _ in fields(start, end) if n == 3), UNIGRAM)
    return UNIGRAM


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if raw[at - 1] < 128:
            return value, at


class Vocabulary:
    """Pieces, scores and special ids of a model file, with the automaton over its normal pieces."""

    def __init__(self, path: str | None = None, raw: bytes | None = None):
        if raw is None:
            with open(path, "rb") as f:
                raw = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        if sp.normalize("a  b") != f"{MARK}a{MARK}{MARK}b":
            raise ValueError("only models with identity normalization and a leading space mark are read")
        self.kind = model_type(raw)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge vocabularies are read")
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unk = sp.unk_id()
        byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in byte_of.items()}
        normal = [i for i in range(n) if not (i == self.unk or sp.is_control(i) or i in byte_of or sp.is_unused(i))]
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.unk_score = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        # what an id decodes to; bytes from 128 as lone surrogates until they are read as UTF-8
        self.text_of = [p.replace(MARK, " ") for p in self.pieces]
        for i in range(n):
            if sp.is_control(i):
                self.text_of[i] = ""
            elif i in byte_of:
                self.text_of[i] = chr(byte_of[i]) if byte_of[i] < 128 else chr(0xDC00 + byte_of[i])
        self.text_of[self.unk] = " \u2047 "
        self.automaton = ahocorasick.Automaton()
        #: The two parts whose merge makes a piece, and pieces not made after all of their parts' merges.
        self.halves: dict[str, tuple[str, str]] = {}
        self.odd: set[str] = set()
        for i in sorted(normal, key=lambda i: len(self.pieces[i])):
            p = self.pieces[i]
            if self.kind == BPE and len(p) > 1:
                parts = self.merged(p, 2)
                if len(parts) > 2 or "".join(parts) != p:
                    continue  # merges never make it
                self.halves[p] = parts[0], parts[1]
                if any(h in self.odd or (len(h) > 1 and self.score[h] <= self.score[p]) for h in parts):
                    self.odd.add(p)
            self.automaton.add_word(p, (len(p), self.score[p], i) if self.kind == UNIGRAM else (len(p), i))
        self.automaton.make_automaton()
        self.single = {p for p in self.score if len(p) == 1}
        letters = {c for p in self.score for c in p}
        self.loose = letters - self.single  # only in longer pieces
        stops = "".join(c for c in "\n\t\r" if c not in letters)
        #: Neighbouring characters that some piece holds.
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.newline_cuts = "\n" in stops
        inside = any(MARK in p.lstrip(MARK) for p in self.score)
        tail = f"[^{MARK}{stops}]"
        self.chunks = None if inside else re.compile(f"{MARK}+{tail}*|{tail}+" + (f"|[{stops}]" if stops else ""))
        self.forget()

    def forget(self) -> None:
        """Drop all that was remembered of texts: at the end of a task, as Spark keeps its Python workers."""
        self.beside: dict[int, bool] = {}
        self.memo: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.counts: tuple[dict[str, int], dict[str, int]] = ({}, {})

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Merges by definition: of all neighbours that make a piece, the best score first, from the left."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, a: str, b: str) -> bool:
        """Do two pieces side by side come out of the merges as they are?

        They do if at no time a merge across their border came before the next merge on either side.  Pieces are made
        later than their parts, so time is walked back by taking apart whichever piece was made later.
        """
        score, halves = self.score, self.halves
        if a in self.odd or b in self.odd:
            return self.merged(a + b) == [a, b]
        if a + b in score:
            return False
        while True:
            left, right = len(a) > 1, len(b) > 1
            if not (left or right):
                return True
            undo_left = left and (not right or score[a] < score[b])
            due = score[a] if undo_left else score[b]
            if undo_left:
                a = halves[a][1]
            else:
                b = halves[b][0]
            across = score.get(a + b)
            # at equal scores the merge further left comes first
            if across is not None and (across > due or (across == due and not undo_left)):
                return False

    def _unknown(self, char: str) -> list[int]:
        if not self.byte_id:
            return [self.unk]
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]

    def _known_parts(self, chunk: str) -> Iterator[tuple[str, bool]]:
        """The chunk cut at characters that are in no piece: (part, is it known)."""
        at = 0
        for i, c in enumerate(chunk):
            if c not in self.single and c not in self.loose:
                if at < i:
                    yield chunk[at:i], True
                yield c, False
                at = i + 1
        if at < len(chunk):
            yield chunk[at:], True

    def solve(self, chunk: str) -> list[int]:
        """Ids of a chunk."""
        if self.single.issuperset(chunk):
            return self._solve(chunk)
        out: list[int] = []
        for part, known in self._known_parts(chunk):
            out += self._solve(part) if known else self._unknown(part)
        return out

    def count_chunk(self, chunk: str) -> int:
        """Number of ids of a chunk."""
        if self.single.issuperset(chunk):
            return self._count(chunk)
        return sum(self._count(part) if known else len(self._unknown(part)) for part, known in self._known_parts(chunk))

    def _solve(self, chunk: str) -> list[int]:
        length_at, id_at = self._viterbi(chunk) if self.kind == UNIGRAM else self._last_pieces(chunk)
        out, n = [], len(chunk)
        while n:
            i = id_at[n]
            out.append(i if i >= 0 else self._unknown(chunk[n - 1]))
            n -= length_at[n]
        out.reverse()
        if self.loose:
            return [x for part in out for x in (part if isinstance(part, list) else (part,))]
        return out

    def _viterbi(self, chunk: str) -> tuple[list[int], list[int]]:
        """Length and id of the last piece of the best segmentation of each prefix."""
        size = len(chunk)
        best, length_at, id_at = [0.0] + [None] * size, [0] * (size + 1), [-1] * (size + 1)
        if self.loose:
            return self._viterbi_loose(chunk, best, length_at, id_at)
        for end, (length, score, i) in self.automaton.iter(chunk):
            end += 1
            reached = best[end - length] + score
            if best[end] is None or reached > best[end]:
                best[end], length_at[end], id_at[end] = reached, length, i
        return length_at, id_at

    def _viterbi_loose(self, chunk: str, best: list, length_at: list, id_at: list) -> tuple[list[int], list[int]]:
        """As above where some characters are no pieces by themselves: those may also be an unknown each."""
        ends: dict[int, list] = {}
        for end, piece in self.automaton.iter(chunk):
            ends.setdefault(end + 1, []).append(piece)
        for end in range(1, len(chunk) + 1):
            for length, score, i in ends.get(end, ()):
                reached = best[end - length] + score
                if best[end] is None or reached > best[end]:
                    best[end], length_at[end], id_at[end] = reached, length, i
            reached = best[end - 1] + self.unk_score
            if chunk[end - 1] in self.loose and (best[end] is None or reached > best[end]):
                best[end], length_at[end], id_at[end] = reached, 1, -1
        return length_at, id_at

    def _fits(self, before: int, i: int) -> bool:
        """Can piece ``i`` stand behind piece ``before`` (-1: an unknown)?"""
        if len(self.beside) >= PAIRS:
            self.beside.clear()
        fits = before < 0 or self._stay_apart(self.pieces[before], self.pieces[i])
        self.beside[before * len(self.pieces) + i] = fits
        return fits

    def _last_pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Length and id of the last piece of the merged encoding of each prefix; a character of no piece starts anew."""
        size, beside, n = len(text) + 1, self.beside, len(self.pieces)
        length_at, id_at = [0] * size, [-1] * size
        for end, (length, i) in self.automaton.iter(text):
            end += 1
            if length_at[end]:
                continue
            before = id_at[end - length]
            fits = beside.get(before * n + i)
            if not (self._fits(before, i) if fits is None else fits):
                continue
            length_at[end], id_at[end] = length, i
        if self.loose:
            for end in range(1, size):
                length_at[end] = length_at[end] or 1
        return length_at, id_at

    def _counts(self, text: str) -> list[int]:
        """Pieces of the merged encoding of each prefix: one more than what lies before its last piece."""
        size, beside, n = len(text) + 1, self.beside, len(self.pieces)
        pieces, id_at = [0] * size, [-1] * size
        for end, (length, i) in self.automaton.iter(text):
            end += 1
            if pieces[end]:
                continue
            start = end - length
            before = id_at[start]
            fits = beside.get(before * n + i)
            if not (self._fits(before, i) if fits is None else fits):
                continue
            pieces[end], id_at[end] = pieces[start] + 1, i
        return pieces

    def _count(self, chunk: str) -> int:
        """As ``_solve``, with the number of pieces carried forward and nothing traced back (but for loose vocabularies)."""
        if self.loose:
            return len(self._solve(chunk))
        if self.kind == BPE:
            return self._counts(chunk)[-1]
        best, pieces = [0.0] + [None] * len(chunk), [0] * (len(chunk) + 1)
        for end, (length, score, _) in self.automaton.iter(chunk):
            end += 1
            reached = best[end - length] + score
            if best[end] is None or reached > best[end]:
                best[end], pieces[end] = reached, pieces[end - length] + 1
        return pieces[-1]

    def _ids_of(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks as 32-bit integers: those of plain characters in one pass, with characters of no piece between them."""
        found, plain = self._sorted_out(chunks, lambda c: array("i", self.solve(c)).tobytes())
        length_at, id_at = self._last_pieces("\0".join(plain))
        at = 0
        for c in plain:
            n, out = at + len(c), []
            while n > at:
                out.append(id_at[n])
                n -= length_at[n]
            out.reverse()
            found[c] = array("i", out).tobytes()
            at += len(c) + 1
        return found

    def _sizes_of(self, chunks: list[str]) -> dict[str, int]:
        """As above, the number of ids."""
        found, plain = self._sorted_out(chunks, self.count_chunk)
        pieces, at = self._counts("\0".join(plain)), -1
        for c in plain:
            at += len(c) + 1
            found[c] = pieces[at]
        return found

    def _sorted_out(self, chunks: list[str], solve) -> tuple[dict, list[str]]:
        """Chunks that are solved on their own, with what they give, and the others."""
        if self.kind == UNIGRAM or self.loose or "\0" in self.single:
            return {c: solve(c) for c in chunks}, []
        plain = [c for c in chunks if self.single.issuperset(c)]
        return {c: solve(c) for c in chunks if not self.single.issuperset(c)}, plain

    def split(self, text: str) -> list[str]:
        """Chunks of a text that no piece crosses."""
        if self.chunks is None:
            return [MARK + text.replace(" ", MARK)]
        if self.newline_cuts and text[0] != " " != text[-1] and not any(odd in text for odd in _ODD_SPACES):
            # single spaces: words of lines; only the first word of a later line has no mark
            return list(filter(None, (MARK + text.replace(" ", _CUT).replace("\n", "\0\n\0")).split("\0")))
        return self.chunks.findall(MARK + text.replace(" ", MARK))

    def _cut(self, chunk: str) -> int:
        """Where punctuation at a chunk's end begins, if no piece goes across; else 0."""
        tail = _PUNCTUATION.search(chunk)
        at = tail.start() if tail else 0
        return at if at and chunk[at - 1 : at + 1] not in self.pairs else 0

    def _look_up(self, chunks: list[str], memo: tuple[dict, dict], solve) -> dict:
        """See to it that ``memo`` knows the chunks; gives those that are not to be remembered.

        Values are bytes or numbers: that of a chunk is the sum of those of its parts.
        """
        new, old = memo
        cut, todo, others = [], set(), {}
        for c in set(chunks).difference(new):
            value = old.get(c)
            if value is not None:
                new[c] = value
                continue
            at = 0 if c[-1].isalnum() else self._cut(c)
            if at:
                cut.append((c, c[:at], c[at:]))
                todo.update(part for part in cut[-1][1:] if part not in new and part not in old)
            else:
                todo.add(c)
        if not (todo or cut):
            return others
        fresh = solve(list(todo))
        for c, head, tail in cut:
            fresh[c] = _first(head, fresh, new, old) + _first(tail, fresh, new, old)
        for c, value in fresh.items():
            if len(c) <= MEMO_CHARS and (isinstance(value, int) or self._spelt(memoryview(value).cast("i")) == c.replace(MARK, " ")):
                new[c] = value
            else:
                others[c] = value
        return others

    def encoded(self, text: str) -> tuple[bytes, bool]:
        """(ids as 32-bit integers, do they decode to the text).

        Decoding is checked chunk by chunk, when a chunk is solved; a text decodes to itself if its chunks do and make up the text.
        """
        if not text:
            return b"", True
        chunks, known = self.split(text), self.memo[0]
        others = self._look_up(chunks, self.memo, self._ids_of)
        out = b"".join((known.get(c) or others[c] for c in chunks) if others else map(known.__getitem__, chunks))
        # a space mark in the text itself decodes to a space
        same = MARK not in text and "".join(chunks) == MARK + text.replace(" ", MARK)
        same = same and all(self._spelt(memoryview(v).cast("i")) == c.replace(MARK, " ") for c, v in others.items())
        if len(known) >= MEMO:
            self.memo = {}, known
        return out, same

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encoded(text)[0]).cast("i"))

    def count(self, text: str) -> int:
        if not text:
            return 0
        chunks, known = self.split(text), self.counts[0]
        others = self._look_up(chunks, self.counts, self._sizes_of)
        total = sum((known.get(c) or others[c] for c in chunks) if others else map(known.__getitem__, chunks))
        if len(known) >= MEMO:
            self.counts = {}, known
        return total

    def _spelt(self, ids) -> str:
        text = "".join(map(self.text_of.__getitem__, ids))
        if not text.isascii() and _HIGH_BYTE.search(text):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids vanish, byte runs are UTF-8, marks are spaces, the leading one is dropped."""
        text = self._spelt(ids)
        return text[1:] if text[:1] == " " else text


def _first(key: str, *tables: dict):
    return next(t[key] for t in tables if key in t)


_CUT = "\0" + MARK
#: Texts with any of these, or with spaces at an end, are split by the slower pattern.
_ODD_SPACES = ("  ", " \n", "\n ", MARK, "\0")
_PUNCTUATION = re.compile(rf"[^\w{MARK}]+$")
_HIGH_BYTE = re.compile("[\udc80-\udcff]")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One copy a Python worker; the file must be there on every executor (as the library's is)."""
    return Vocabulary(path)


#: Rows in a batch that goes back to Spark: ids of long texts must not pile up in a worker.
ROWS = 256


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids, round_trip)`` for every row; round_trip says whether decoding the ids gives the text back.

    Null texts are encoded as empty texts: no ids, and ``round_trip`` is true.  A text that holds the space mark itself decodes to a space,
    so its ``round_trip`` is false.  Texts are encoded whole, however long: a worker holds the ids of ``ROWS`` of them.  Null ids stay null, repeated
    rows each get their row, extra columns are ignored, an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, same = zip(*(vocab.encoded(t or "") for t in part.column(1).to_pylist()), strict=True)
                sizes = np.array([len(x) // 4 for x in ids])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), lists, pa.array(same)], ["id", "n_tokens", "ids", "round_trip"])
        vocab.forget()

    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode_documents(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` from arrays of ids; null arrays give null, null ids and ids outside of the vocabulary are dropped.

    Arrays are decoded whole, however long.  Null row ids stay null, repeated rows each get their row, extra columns are ignored,
    an empty table gives an empty result.
    """
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [
                    None if ids.as_py() is None else vocab.decode([i for i in ids.as_py() if i is not None and 0 <= i < len(vocab.pieces)])
                    for ids in part.column(1)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = tokens.select(ref(id_col).alias("id"), ref(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def count_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_chars)`` for every row, without building ids.

    Null and empty texts have 0 of both.  Texts are counted whole, however long.  Null ids stay null, repeated rows each get their row, extra
    columns are ignored, an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([vocab.count(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "n_tokens", "n_chars"],
            )
        vocab.forget()

    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_chars long").withColumnRenamed("id", id_col)
