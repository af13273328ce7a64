"""Fill-in-the-middle transformation of documents, with token boundaries found in big integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import lean

#: Marks of the three parts. A text that holds one of them stays plain, so an output has one way back.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes to digits: is it white space or not? ASCII white space is never a part of another character.
_SOLID = bytes(48 if b == 0x20 or 0x09 <= b <= 0x0D else 49 for b in range(256))


def token_ends(raw: bytes) -> int:
    """A big integer whose bit i says that a token ends with byte i.

    A token is white space and the run of other bytes after it, or white space at the end. So
    one ends where a solid byte has no solid byte after it, and at the last byte.
    """
    if not raw:
        return 0
    solid = int(raw.translate(_SOLID)[::-1], 2)
    return (solid & ~(solid >> 1)) | (1 << (len(raw) - 1))


def place_of(mask: int, k: int) -> int:
    """The place of the k-th set bit, from 1, by halving: each step keeps the half that holds it."""
    at, width = 0, mask.bit_length()
    while width > 1:
        half = width // 2
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if k <= n:
            mask, width = low, half
        else:
            mask, width, k, at = mask >> half, width - half, k - n, at + half
    return at


def parts(raw: bytes, one: int, two: int) -> tuple[int, int, int]:
    """(number of tokens n, end of the prefix, end of the middle), in bytes: after one % (n + 1) and two % (n + 1) tokens."""
    mask = token_ends(raw)
    n = mask.bit_count()
    first, second = sorted((one % (n + 1), two % (n + 1)))
    return n, *(place_of(mask, k) + 1 if k else 0 for k in (first, second))


def draws(seed: str, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def fill_in_middle(docs: DataFrame, seed: str = "42", rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row per input row: doc_id, n, form, prefix_chars, middle_chars, output and the columns ``carry``.

    ``n`` counts the tokens of the whole text: white space with the word after it, or white space
    at the end. The digest of the seed and the id gives two cuts between tokens, the form, and
    with it the order of parts: ``rate`` percent are rearranged, of those ``spm_rate`` percent
    suffix first. The form is plain, and the output the text, for other documents, for empty and
    null texts, and for texts that hold a mark; prefix_chars and middle_chars are then null.

    Rows are independent: rows that repeat an id draw alike, a null id draws as an empty one, an
    empty table gives none, and of further columns only those of ``carry`` are read, under any
    name. A text's mask takes a bit a byte, so that very long texts need little beside themselves.
    """
    carried = [f"_carry{k}" for k in range(len(carry or []))]
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"), *(docs[f"`{c}`"].alias(x) for c, x in zip(carry or [], carried, strict=True)))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def rearranged(raw: bytes, doc_id: int | None) -> tuple:
        h = draws(seed, doc_id)
        n, cut, end = parts(raw, h[0], h[1])
        if not raw or h[2] % 100 >= rate or any(m in raw for m in marks):
            return n, "plain", None, None, raw
        head, middle, tail = raw[:cut], raw[cut:end], raw[end:]
        form = "spm" if h[3] % 100 < spm_rate else "psm"
        p, s, m = marks
        out = b"".join((s, tail, p, head, m, middle) if form == "spm" else (p, head, s, tail, m, middle))
        return n, form, len(head.decode()), len(middle.decode()), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        with lean():
            for batch in batches:
                made = [rearranged(raw, i) for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)]
                arrays = [pa.array(x, k) for x, k in zip(zip(*made, strict=True) if made else [()] * 5, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:4], arrays[4].cast(pa.string()), *batch.columns[2:]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", *carried])

    more = "".join(f", {x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(carry or [], carried, strict=True))
    out = rows.mapInArrow(run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, output string{more}")
    return out.withColumnsRenamed(dict(zip(carried, carry or [], strict=True)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from: its parts between the marks, each of which it holds once."""

    def between(start: str, end: str | None) -> Column:
        after = F.substring_index(output, start, -1)
        return F.substring_index(after, end, 1) if end else after

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
