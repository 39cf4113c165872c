"""Fill-in-middle: texts cut in three at two unit borders, and put together with the middle last.

Texts are emitted as pieces, chunks of units of bounded size, each with its place in the output.  One shuffle by document, sorted
by place within partitions (``repartition`` and ``sortWithinPartitions``, the DataFrame form of repartitionAndSortWithinPartitions),
streams them into incremental digests of the outputs; no task ever holds a whole output.  Restoration reads that stream, tells the parts
by their markers, and sorts within the same partitions once more, by place in the text, into a second digest: no second shuffle.

A text's units are runs of white space with the word behind them; what is cut, and how, follows from a SHA-256 of seed and id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ref

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = MARKERS = "<P>", "<S>", "<M>"
#: A piece has so many units and code points at most.
PIECE_UNITS, PIECE_CHARS = 1_024, 16_384
#: Code points that a task gathers before it hands pieces on.
HELD = 1 << 21
#: Order of the parts in the text; what ends a document comes last.
PART_ORDER = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
END = 9


@dataclass(frozen=True)
class Fim:
    """Per cent of documents that are rearranged, and of those, per cent that start with the suffix; seed of all choices."""

    rate: int = 50
    suffix_first: int = 80
    seed: int = 42

    def plan(self, text: str, doc_id: object) -> tuple[np.ndarray, str, int, int]:
        """Ends of the units, form, end of the prefix, end of the middle."""
        ends = np.fromiter((m.end() for m in UNIT.finditer(text)), np.int64)
        n = len(ends)
        hexed = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in range(0, 32, 8))
        if not n or any(m in text for m in MARKERS) or h3 % 100 >= self.rate:
            return ends, "plain", 0, 0
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        return ends, "spm" if h4 % 100 < self.suffix_first else "psm", int(ends[low - 1]) if low else 0, int(ends[high - 1]) if high else 0


def chunks(text: str, start: int, end: int, ends: np.ndarray) -> Iterator[str]:
    """``text[start:end]``, cut at unit borders and, where units are long, between them."""
    inside = ends[np.searchsorted(ends, start, "right") :]
    inside = inside[: np.searchsorted(inside, end, "left")]
    for border in [*inside[PIECE_UNITS - 1 :: PIECE_UNITS].tolist(), end]:
        while start < border:
            stop = min(border, start + PIECE_CHARS)
            yield text[start:stop]
            start = stop


def pieces_of(text: str, ends: np.ndarray, form: str, low: int, high: int) -> Iterator[str]:
    """The output in pieces; each marker is a piece of its own."""
    if form == "plain":
        yield from chunks(text, 0, len(text), ends)
        return
    parts = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, len(text))}
    for marker in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        yield marker
        yield from chunks(text, *parts[marker], ends)


def emit_pieces(docs: DataFrame, fim: Fim, id_col: str, text_col: str) -> DataFrame:
    """``(row, place, piece, doc_id, n, form, prefix_chars, middle_chars)``; what is said of a document stands at place 0, its id as text."""
    # a number for each row, so that rows with one id (or equal rows) stay apart and are dealt to many tasks
    rows = docs.select(F.monotonically_increasing_id().alias("row"), ref(id_col).cast("string").alias("doc_id"), F.coalesce(ref(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["row", "place", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                ends, form, low, high = fim.plan(text, doc_id)
                said = (doc_id, len(ends), form, None if form == "plain" else low, None if form == "plain" else high - low)
                for place, piece in enumerate(pieces_of(text, ends, form, low, high)) if text else [(0, "")]:
                    out.append((row, place, piece, *(said if not place else (None,) * 5)))
                    held += len(piece)
                    if held > HELD:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)

    return rows.mapInPandas(emit, "row long, place long, piece string, doc_id string, n long, form string, prefix_chars long, middle_chars long")


def assembled(pieces: DataFrame) -> DataFrame:
    """All pieces of an output in one task, in order."""
    return pieces.repartition(F.col("row")).sortWithinPartitions("row", "place")


def _streamed(batches: Iterator[pd.DataFrame], columns: list[str], step, names: list[str]) -> Iterator[pd.DataFrame]:
    """Runs ``step`` over rows and hands on what it appends, a batch for a batch."""
    for batch in batches:
        out: list[tuple] = []
        for values in zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in columns), strict=True):
            step(values, out)
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)
    out = []
    step(None, out)
    if out:
        yield pd.DataFrame(out, columns=names, dtype=object)


def digest_outputs(pieces: DataFrame) -> DataFrame:
    """Streams assembled pieces into digests: ``(row, part, place, piece, ...)``, pieces without markers by their part in the text.

    A row that ends a document bears its output's digest and what is said of it.  Parts are told from the output alone.
    """
    said = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    names = ["row", "part", "place", "piece", *said, "output_sha256"]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"row": None}

        def step(values: tuple | None, out: list[tuple]) -> None:
            if state["row"] is not None and (values is None or values[0] != state["row"]):
                out.append((state["row"], END, 0, None, *state["said"], state["sha"].hexdigest()))
            if values is None:
                return
            row, place, piece, *about = values
            if row != state["row"]:
                state.update(row=row, said=about, sha=hashlib.sha256(), part=0)
            state["sha"].update(piece.encode())
            if state["said"][2] != "plain" and piece in PART_ORDER:
                state["part"] = PART_ORDER[piece]
            elif piece:
                out.append((row, state["part"], place, piece, *(None,) * 6))

        yield from _streamed(batches, ["row", "place", "piece", *said], step, names)

    return pieces.mapInPandas(digest, "row long, part int, place long, piece string, doc_id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string")


def digest_restored(parts: DataFrame) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)``, from parts sorted by place in the text."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {"sha": hashlib.sha256()}

        def step(values: tuple | None, out: list[tuple]) -> None:
            if values is None:
                return
            part, piece, *about = values
            if part != END:
                state["sha"].update(piece.encode())
                return
            out.append((*about, state["sha"].hexdigest()))
            state["sha"] = hashlib.sha256()

        yield from _streamed(batches, ["part", "piece", *names[:-1]], step, names)

    return parts.mapInPandas(digest, "doc_id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def fim_digests(docs: DataFrame, fim: Fim | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of ``docs``: units, form, lengths of prefix and middle, digests of the output and of the text restored from it.

    Null and empty texts are plain, with no units; a text that holds a marker is plain, too.  Repeated ids and equal rows each give
    a row; a null id is chosen for as an empty one.  An empty table gives no rows.  Texts of any length are handled in
    pieces.  Other columns are not read, whatever their names.  ``docs`` must come from files (or a checkpoint), so that a lost
    task meets the same rows in the same order.
    """
    parts = digest_outputs(assembled(emit_pieces(docs, fim or Fim(), id_col, text_col)))
    found = digest_restored(parts.sortWithinPartitions("row", "part", "place"))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("doc_id", id_col)


def fim_texts(docs: DataFrame, fim: Fim | None = None, id_col: str = "doc_id", text_col: str = "text", out: str = "output") -> DataFrame:
    """``docs`` with the rearranged text in ``out`` (and its form in ``out`` + ``_form``): a projection, since a text fits where it is read.

    Null texts stay null, in plain form; rows, repeats and other columns stay as they are; ``out`` replaces a column of that name.
    """
    chosen = fim or Fim()

    @F.pandas_udf("struct<output:string,form:string>")
    def rearranged(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        found = []
        for text, name in zip(texts, names, strict=True):
            ends, form, low, high = chosen.plan(text or "", name)
            found.append((None if text is None else "".join(pieces_of(text, ends, form, low, high)), form))
        return pd.DataFrame(found, columns=["output", "form"], dtype=object)

    made = rearranged(ref(text_col).cast("string"), ref(id_col).cast("string"))
    return docs.withColumns({out: made["output"], f"{out}_form": made["form"]})


def restore(output: str | None, form: str) -> str | None:
    """The text of an output."""
    if output is None or form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one
