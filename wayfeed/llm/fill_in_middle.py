"""Fill-in-middle transformation of whole texts, with a sparse index of multibyte characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, text_or_empty

MARKS = ("<P>", "<S>", "<M>")


class Multibyte:
    """Byte and code-point positions of UTF-8 data, from its multibyte characters alone.

    Held are the byte positions of the first bytes of such characters and how many bytes they have beyond one, summed.
    Data without any costs nothing: there both kinds of position are the same number.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.zeros(len(self.at) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=self.excess[1:])

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte position (a character border)."""
        return byte - self.excess[np.searchsorted(self.at, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Byte position of each code-point position."""
        return char + self.excess[np.searchsorted(self.at - self.excess[:-1], char)]


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units of each text, byte positions where prefix and middle end, and the code points of prefix and middle."""
    start, end = offsets[:-1], offsets[1:]
    index = Multibyte(data)
    first = index.chars(start)
    if unit == "line":
        breaks = np.flatnonzero(data == 10)
        low = np.searchsorted(breaks, start)
        whole = np.searchsorted(breaks, end) - low
        last_is_break = np.zeros(len(start), bool)
        last_is_break[end > start] = data[end[end > start] - 1] == 10
        n = whole + ((end > start) & ~last_is_break)
    else:
        n = index.chars(end) - first
    a, b = h1 % (n + 1), h2 % (n + 1)
    a, b = np.minimum(a, b), np.maximum(a, b)

    def at(units: np.ndarray) -> np.ndarray:
        if unit != "line":
            return index.bytes(first + units)
        out = np.where(units > whole, end, start)
        inside = (units > 0) & (units <= whole)
        out[inside] = breaks[(low + units - 1)[inside]] + 1
        return out

    one, two = at(a), at(b)
    return n, one, two, index.chars(one) - first, index.chars(two) - index.chars(one)


def holding(data: np.ndarray, offsets: np.ndarray, marks: tuple[str, ...]) -> np.ndarray:
    """Which texts contain one of ``marks``."""
    raw, found = data.tobytes(), np.zeros(len(offsets) - 1, bool)
    for mark in map(str.encode, marks):
        at = raw.find(mark)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, side="right")) - 1
            inside = at + len(mark) <= offsets[k + 1]
            found[k] |= inside
            at = raw.find(mark, int(offsets[k + 1]) if inside else at + 1)
    return found


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", fim_percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n_units, form, prefix_chars, middle_chars, output: each whole text rearranged for fill-in-middle training.

    A text is cut at two places between its units: lines (``line``: up to and with a line feed, the last one without) or
    code points (``char``).  Places, form and the choice of texts come from four 32-bit numbers of sha256 of
    ``seed:doc_id``, so they depend on nothing else.  ``psm`` is prefix, suffix, middle, each after its mark; ``spm`` is
    suffix, prefix, middle; ``plain`` is the text as it is: empty ones, those that contain a mark, and 100 minus
    ``fim_percent`` of the rest.  Counts are code points, NULL if plain.  ``restored`` gives the text back exactly.

    A NULL text is empty; a NULL id counts as an empty text in the hash; repeated rows give equal rows; other columns are
    ignored; an empty table gives an empty one.  Each text is worked on alone, whole, in slices of about 2 MB.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"unknown unit {unit!r}")
    if len(set(marks)) < 3 or any(not m or m in other for m in marks for other in marks if m is not other):
        raise ValueError("marks must be different and none part of another")
    if any(m.startswith(m[k:]) for m in marks for k in range(1, len(m))):
        raise ValueError("a mark must not end as it begins, else its place could not be found again")
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    source = docs.select("doc_id", text_or_empty().alias("text"), sha.alias("sha"))
    numbers = [F.conv(F.substring("sha", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    source = source.select("doc_id", "text", *numbers)
    p, s, m = map(str.encode, marks)

    def step(rows, data, offsets):
        h = [rows.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
        n, one, two, prefix, middle = cuts(data, offsets, h[0], h[1], unit)
        plain = (offsets[1:] == offsets[:-1]) | (h[2] % 100 >= fim_percent) | holding(data, offsets, marks)
        spm = h[3] % 100 < spm_percent
        raw, out = data.tobytes(), []
        for i, (start, a, b, end) in enumerate(zip(offsets.tolist(), one.tolist(), two.tolist(), offsets[1:].tolist())):
            if plain[i]:
                out.append(raw[start:end])
            elif spm[i]:
                out.append(b"".join((s, raw[b:end], p, raw[start:a], m, raw[a:b])))
            else:
                out.append(b"".join((p, raw[start:a], s, raw[b:end], m, raw[a:b])))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        columns = [rows.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(source, step, f"doc_id {kind}, n_units long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind ``output`` of ``fill_in_middle``, from the output and its form alone."""
    p, s, m = marks

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands after ``first``, after ``second``, and after the mark of the middle."""
        body = F.substring(output, F.lit(len(first) + 1), F.char_length(output))
        at = F.locate(second, body)
        rest = F.substring(body, at + len(second), F.char_length(body))
        then = F.locate(m, rest)
        return F.substring(body, F.lit(1), at - 1), F.substring(rest, F.lit(1), then - 1), F.substring(rest, then + len(m), F.char_length(rest))

    prefix, suffix, middle = between(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
