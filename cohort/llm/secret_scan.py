"""Secret scans with a recursive decoding worklist.

The base scan finds assignments, access keys and long hex runs in a text.  The worklist then unwraps what the text may
hide: percent-encoding, Unicode escapes (``\\uXXXX``, ``\\xXX``, ``&#N;``), base64 runs, and compressed bytes inside
any of them (gzip, zlib, bzip2, xz, zstd).  Every layer is scanned and unwrapped again until nothing new appears; a layer that was
seen at the same place is not taken up again, which ends cycles.  Each layer keeps, for every character, the span
of the original text that it came from, so secrets in any depth map back to the original text.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ref

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as runs of which shorter ones are dropped
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"((?:\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}))|\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})"
    r"|\\x([0-9a-fA-F]{2})|&\#[xX]([0-9a-fA-F]{1,6});|&\#([0-9]{1,7});"
)
#: Percent-encoding and escapes are unwrapped one by one to this depth, and beyond it all at once, so that the work stays linear.
DEEP = 8
#: Encodings of a mark that starts an encoding: what stays is the mark, and the last of them.
_CHAIN = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})|\\(?:u005[cC]|x5[cC]|u\{0*5[cC]\}|U0000005[cC])+|&(?:\#0*38;|\#[xX]0*26;)+")
_CLOSES = frozenset("0123456789abcdefABCDEF;}")
_CLOSED = re.compile(rf"(?:%([0-9A-Fa-f]{{2}})|({_ESCAPE.pattern}))\Z")
#: Longest escape.
_LONGEST = 12
#: Shortest base64 run that is unwrapped; shorter ones cannot hold an assignment with a value.
MIN_BASE64 = 16
_BREAK = r"[\x20\t]*\r?\n[\x20\t]*"
_WORD = re.compile(r"[A-Za-z0-9+/_-]+")
#: Whole words, joined over single line ends: base64 may be wrapped at any width.
_BASE64 = re.compile(
    rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}+|[A-Za-z0-9+/_-]++(?={_BREAK}[A-Za-z0-9+/_-]))(?:{_BREAK}[A-Za-z0-9+/_-]++)*+={{0,2}}"
)
#: What a path, a prefix or a suffix leaves of a run.
_PART = re.compile(r"[A-Za-z0-9]{16,}")
_STANDARD = str.maketrans("-_", "+/")
#: Stretches of decoded bytes that are scanned, and their bytes a character (UTF-8, UTF-16).  Secrets and wrappings are ASCII and no
#: shorter, so what else stands in the layer (other letters, marks, binary bytes) neither hides nor makes one.
_STRETCHES = ((re.compile(rb"[\t\n\r\x20-\x7e]{12,}"), 1), (re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){11,}[\t\n\r\x20-\x7e]"), 2))
#: Heads of gzip, zlib, bzip2, xz and zstd.
_MAGIC = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
_FAULTS = (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError)
#: Unpacked content is scanned in pieces of about this size, so that memory holds little of it, however much there is.
PIECE = 1 << 22
#: Pieces end behind a character of no secret or wrapping; if there is none, the next piece repeats so many bytes.
OVERLAP = 1 << 20
_MARK = re.compile(rb"(?s:.*)[^A-Za-z0-9+/_.=\-\"':\x20\t\r\n%\\&#;{}\0]")
#: Compressed bytes to hand over at once.
_SLICE = 256
#: Stretches that spell bytes, what makes them worth reading as bytes, and their units.
_SPELT = (
    (re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-$&-~])+"), re.compile(r"%[0189A-Fa-f]"), re.compile(r"(?s)%(..)|(.)")),
    (re.compile(r"""(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0'"\\]|[\x20-\[\]-~])+"""), re.compile(r"\\x[0189A-Fa-f]"), re.compile(r"(?s)\\x(..)|\\?(.)")),
)
_LETTERS = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base scan, by start then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    """A decoded text; character ``i`` came from ``[starts[i], ends[i])`` of the original."""

    text: str
    starts: list[int] | range
    ends: list[int] | range
    #: Layers of percent-encoding and escapes above it, with nothing else between.
    depth: int = 0

    def key(self) -> tuple[bytes, int, int]:
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return digest, self.starts[0], self.ends[-1]


class _Builder:
    """Puts a layer together from copied and decoded stretches of its parent."""

    def __init__(self, parent: Layer):
        self.parent, self.parts, self.starts, self.ends, self.changed = parent, [], [], [], False

    def copy(self, a: int, b: int) -> None:
        self.parts.append(self.parent.text[a:b])
        self.starts.extend(self.parent.starts[a:b])
        self.ends.extend(self.parent.ends[a:b])

    def put(self, char: str, a: int, b: int) -> None:
        self.parts.append(char)
        self.starts.append(self.parent.starts[a])
        self.ends.append(self.parent.ends[b - 1])
        self.changed = True

    def layer(self) -> Iterator[Layer]:
        if self.changed and self.starts:
            yield Layer("".join(self.parts), self.starts, self.ends, self.parent.depth + 1)


def _utf8_chars(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Characters with their byte spans; each byte that is not UTF-8 gives a replacement character."""
    at = 0
    for c in raw.decode("utf-8", "surrogateescape"):
        bad = "\udc80" <= c <= "\udcff"
        n = 1 if bad else len(c.encode("utf-8"))
        yield "\ufffd" if bad else c, at, at + n
        at += n


def _unpercent(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    b, at = _Builder(layer), 0
    for m in _PERCENT.finditer(layer.text):
        b.copy(at, m.start())
        for c, i, j in _utf8_chars(bytes.fromhex(m[0].replace("%", ""))):
            b.put(c, m.start() + 3 * i, m.start() + 3 * j)
        at = m.end()
    b.copy(at, len(layer.text))
    yield from b.layer()


def _code(m: re.Match, first: int = 1) -> int:
    """The character number that a match of ``_ESCAPE`` stands for; its groups begin at ``first``."""
    pair, *hexed, decimal = (m[first + i] for i in range(7))
    if pair:
        return 0x10000 + ((int(pair[2:6], 16) & 0x3FF) << 10) + (int(pair[8:12], 16) & 0x3FF)
    return int(decimal) if decimal else int(next(filter(None, hexed)), 16)


def _is_char(code: int) -> bool:
    return code <= 0x10FFFF and not 0xD800 <= code < 0xE000


def _unescape(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    b, at = _Builder(layer), 0
    for m in _ESCAPE.finditer(layer.text):
        if not _is_char(code := _code(m)):
            continue
        b.copy(at, m.start())
        b.put(chr(code), m.start(), m.end())
        at = m.end()
    b.copy(at, len(layer.text))
    yield from b.layer()


def _peeled(layer: Layer) -> Iterator[Layer]:
    """Chains of encoded marks cut down to their last link, and all that percent-encoding and escapes lead to, each in one pass."""
    b, at = _Builder(layer), 0
    for m in _CHAIN.finditer(layer.text):
        b.copy(at, m.start())
        b.put(m[0][0], m.start(), m.end())
        at = m.end()
    b.copy(at, len(layer.text))
    yield from b.layer()
    chars: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    changed = False
    for c, start, end in zip(layer.text, layer.starts, layer.ends, strict=True):
        while True:
            chars.append(c)
            starts.append(start)
            ends.append(end)
            m = c in _CLOSES and _CLOSED.search("".join(chars[-_LONGEST:]))
            if not m:
                break
            code = int(m[1], 16) if m[1] else _code(m, 3)
            if not _is_char(code):
                break
            n = m.end() - m.start()
            c, start, changed = chr(code) if code < 128 or not m[1] else "\ufffd", starts[-n], True  # and once more: it may close another
            del chars[-n:], starts[-n:], ends[-n:]
    if changed:
        yield Layer("".join(chars), starts, ends, layer.depth + 1)


def _reader(raw: bytes | mmap.mmap, at: int):
    if raw[at] == 0x1F or raw[at] == 0x78:
        return zlib.decompressobj(31 if raw[at] == 0x1F else 15)
    if raw[at] == 0x42:
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(lzma.FORMAT_XZ) if raw[at] == 0xFD else zstandard.ZstdDecompressor().decompressobj()


def _steps(raw: bytes | mmap.mmap, at: int, fine_from: float) -> Generator[bytes, None, int | None]:
    """What the member at ``at`` unpacks to, by the byte from ``fine_from``; returns its end, None if the input ends before."""
    d, inflates, hungry, left, done = _reader(raw, at), raw[at] in b"\x1f\x78", True, b"", 0
    while not d.eof:
        most = 1 if done >= fine_from else 1 << 16
        if hungry:
            left = raw[at : at + (1 if most == 1 else _SLICE)]
            at += len(left)
            if not left:
                return None
        if inflates:
            out = d.decompress(left, most)
            left = d.unconsumed_tail
            hungry = not left and len(out) < most
        elif hasattr(d, "needs_input"):
            out = d.decompress(left, most)
            hungry, left = d.needs_input, b""
        else:
            out = d.decompress(left)
        done += len(out)
        yield out
    return at - len(d.unused_data)


def _member(raw: bytes | mmap.mmap, at: int) -> Generator[bytes, None, int | None]:
    """What the member at ``at`` unpacks to before its end or first fault; returns its end, None without one."""
    done = 0
    try:
        steps = _steps(raw, at, float("inf"))
        while True:
            out = next(steps)
            done += len(out)
            yield out
    except StopIteration as end:
        return end.value
    except _FAULTS:
        pass
    again = 0  # the call that failed gave nothing: once more, by the byte from there
    try:
        for out in _steps(raw, at, done):
            again += len(out)
            if again > done:
                yield out[max(0, len(out) - again + done) :]
    except _FAULTS:
        pass
    return None


def _members(raw: bytes | mmap.mmap, at: int, ends: list[int]) -> Iterator[bytes]:
    """The content of the member at ``at`` and of those that follow at once; ``ends`` gets the place to go on from."""
    while True:
        after = yield from _member(raw, at)
        ends.append(at + 2 if after is None else after)
        if after is None:
            return
        while raw[after : after + 1] == b"\0":
            after += 1
        if not _MAGIC.match(raw, after):
            return
        at = after


def _pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    have = bytearray()
    for part in parts:
        have += part
        if len(have) >= PIECE:
            m = _MARK.match(have, PIECE // 2)
            cut = m.end() if m else len(have)
            yield bytes(have[:cut])
            del have[: cut if m else cut - OVERLAP]
    if have:
        yield bytes(have)


def unpacked(raw: bytes | mmap.mmap, depth: int = 0) -> Iterator[tuple[int, bytes]]:
    """Pieces of the content of all compressed streams in ``raw``, however often compressed, with the streams' places."""
    at = 0
    while depth < 64 and (m := _MAGIC.search(raw, at)):
        ends = [m.start() + 2]
        parts = _members(raw, m.start(), ends)
        head = b""
        while len(head) < 6 and (part := next(parts, None)) is not None:
            head += part
        whole = chain((head,), parts)
        if _MAGIC.match(head):  # compressed twice: the inner stream is not cut
            with tempfile.TemporaryFile() as f:
                f.writelines(whole)
                f.flush()
                with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as inner:
                    yield from ((m.start(), piece) for _, piece in unpacked(inner, depth + 1))
        else:
            for piece in _pieces(whole):
                yield m.start(), piece
                yield from ((m.start(), inner) for _, inner in unpacked(piece, depth + 1))
        at = ends[-1]


def _texts(raw: bytes) -> Iterator[tuple[str, range]]:
    """Stretches of text in bytes, each with the places of its characters' bytes."""
    for pattern, step in _STRETCHES:
        for m in pattern.finditer(raw):
            yield m[0][::step].decode("ascii"), range(m.start(), m.end(), step)


def _coded(text: str) -> Iterator[tuple[str, list[int] | range, int]]:
    """Base64 runs, the places of their characters, and at how many offsets to read them.

    A run joins the words of neighbouring lines and is read at all four offsets, so what stands before the code cannot
    shift it.  Lines and parts between marks are read on their own, too, as a run takes their ends for part of what follows.
    """
    for m in _BASE64.finditer(text):
        words = [w.span() for w in _WORD.finditer(text, m.start(), m.end())]
        at = range(*words[0]) if len(words) == 1 else [i for a, z in words for i in range(a, z)]
        if len(at) < MIN_BASE64:
            continue
        yield (run := "".join(text[a:z] for a, z in words)), at, 4
        pieces = {p.span() for a, z in words for p in _PART.finditer(text, a, z)} | {(a, z) for a, z in words if z - a >= MIN_BASE64}
        yield from ((text[a:z], range(a, z), 1) for a, z in sorted(pieces) if z - a < len(run))


def _unbase64(layer: Layer) -> Iterator[Layer]:
    for run, at, offsets in _coded(layer.text):
        run = run.translate(_STANDARD)
        for skip in range(offsets):
            n = len(run) - skip
            n -= n % 4 == 1
            raw = base64.b64decode(run[skip : skip + n] + "=" * (-n % 4))
            for text, places in _texts(raw):  # three bytes of content to four characters
                starts = [layer.starts[at[skip + i * 4 // 3]] for i in places]
                yield Layer(text, starts, [layer.ends[at[skip + min((i * 4 + 6) // 3, n) - 1]] for i in places])
            z = layer.ends[at[-1]]
            for place, piece in unpacked(raw):
                a = layer.starts[at[skip + place * 4 // 3]]
                for text, _ in _texts(piece):
                    yield Layer(text, [a] * len(text), [z] * len(text))


def _unspell(layer: Layer) -> Iterator[Layer]:
    """Content of bytes that are spelt as ``%XX`` or ``\\xXX`` between plain characters: compressed, or UTF-16."""
    for stretch, binary, unit in _SPELT:
        if not binary.search(layer.text):
            continue
        for m in stretch.finditer(layer.text):
            if not binary.search(m[0]):
                continue
            units = list(unit.finditer(layer.text, m.start(), m.end()))
            raw = bytes(int(u[1], 16) if u[1] else _LETTERS.get(u[2], ord(u[2])) if len(u[0]) > 1 else ord(u[2]) for u in units)
            for text, at in _texts(raw):
                yield Layer(text, [layer.starts[units[i].start()] for i in at], [layer.ends[units[i].end() - 1] for i in at])
            z = layer.ends[m.end() - 1]
            for place, piece in unpacked(raw):
                a = layer.starts[units[place].start()]
                for text, _ in _texts(piece):
                    yield Layer(text, [a] * len(text), [z] * len(text))


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    for unwrap in ((_unpercent, _unescape) if layer.depth < DEEP else (_peeled,)) + (_unspell, _unbase64):
        yield from unwrap(layer)


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those of all decoded layers, mapped to the original text; sorted, without repeats."""
    found, seen = set(base), set()
    work = [_unwrapped(Layer(text, range(len(text)), range(1, len(text) + 1)))]
    while work:  # inner layers first: only those on the way are held
        if (inner := next(work[-1], None)) is None:
            work.pop()
        elif (k := inner.key()) not in seen:
            seen.add(k)
            found.update((inner.starts[s], k_, inner.ends[e - 1]) for s, k_, e in base_spans(inner.text))
            work.append(_unwrapped(inner))
    return sorted(found)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    """(n_assign, n_access, n_hex, SHA-256 of the base spans, all spans) of one whole text."""
    text = text or ""
    base = base_spans(text)
    kinds = [k for _, k, _ in base]
    digest = hashlib.sha256(spell(base).encode()).hexdigest()
    return kinds.count(0), kinds.count(1), kinds.count(2), digest, spell(all_spans(text, base))


def redacted(text: str, mark: str) -> str:
    """The text with each stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in all_spans(text, base_spans(text)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row.

    Null texts are empty texts, without spans.  Repeated rows each get their row, null ids stay null, extra columns are
    ignored, an empty table gives an empty result.  Very long texts are scanned whole; encodings nested in each other take time in
    proportion to the text, however deep.
    """

    @F.pandas_udf(SCAN)
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan_text(t) for t in texts], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(ref(id_col).alias("id"), scan(ref(text_col)).alias("s")).select(F.col("id").alias(id_col), "s.*")


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in the text replaced, encoded ones with their whole wrapping; null texts stay null.

    All columns stay, whatever their names; ``chars_col``, if there, is counted anew for texts that changed.  Repeated rows are each
    masked, very long texts whole; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, mark) for t in texts], dtype=object)

    (new,) = fresh(docs, "redacted_")
    out = docs.withColumn(new, redact(ref(text_col)))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(ref(new).alias(c))
        elif c == chars_col:
            cols.append(F.when(ref(new) != ref(text_col), F.char_length(ref(new)).cast(docs.schema[c].dataType)).otherwise(ref(c)).alias(c))
        else:
            cols.append(ref(c))
    return out.select(*cols)
