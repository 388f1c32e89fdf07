"""Fill-in-middle transformation (operator 11): a constant-memory two-pass streaming matcher.

A text is cut into units, the matches of a pattern from left to right. The first pass only counts them. From the count and the document's
hash follow two ranks; the second pass advances a lazy match iterator to the lower rank, then to the higher one, and stops there. All that is kept of
the units is where the last one ended: no unit, and no array of units, is ever stored. The parts are cut from the text at these two places.

A document that is not left plain becomes `<P>`prefix`<S>`suffix`<M>`middle (form psm) or `<S>`suffix`<P>`prefix`<M>`middle (form spm). Since only
texts without any of the marks are transformed, the marks of an output part it, and `restored` gives the text back.

Everything about a document follows from its doc_id and its text, so there is no shuffle, reruns agree and a lost task is just run again.

Defined results: a null or empty text is plain, with no units; a text that holds a mark is plain; rows that repeat are each reported, and rows that share
a doc_id draw from the same hash; what the pattern doesn't match before the second rank goes with the unit after it; extra columns are
ignored; a row without a doc_id is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, small_batches, text_list, texts

#: Lines with their line feed; the last may lack it.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

Finder = Callable[[str], Iterator[re.Match]]
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def draws(seed: int, doc_id: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def count_units(text: str, find: Finder) -> int:
    """First pass."""
    return sum(1 for _ in find(text))


def unit_ends(text: str, find: Finder, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first `low` units end, and the first `high`."""
    units, at, ends = find(text), 0, []
    for steps in (low, high - low):
        for unit in islice(units, steps):
            at = unit.end()
        ends.append(at)
    return ends[0], ends[1]


def transformed(text: str, doc_id: int, find: Finder, seed: int, percent: int, spm_percent: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and output."""
    n = count_units(text, find)
    one, two, whether, which = draws(seed, doc_id)
    if not text or whether % 100 >= percent or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, z = unit_ends(text, find, low, high)
    p, s, m = marks
    if which % 100 < spm_percent:
        return n, "spm", a, z - a, f"{s}{text[z:]}{p}{text[:a]}{m}{text[a:z]}"
    return n, "psm", a, z - a, f"{p}{text[:a]}{s}{text[z:]}{m}{text[a:z]}"


def fill_in_middle(docs: DataFrame, pattern: str = LINES, seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points) and output of each row of docs(doc_id, text).

    pattern: the units, must not match the empty string. percent of the documents are transformed, spm_percent of these in the form spm.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).finditer
        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            rows = [transformed(t, i, find, seed, percent, spm_percent, marks) for t, i in zip(text_list(part), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((ids, *zip(*rows, strict=True)), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return texts(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from the columns output and form."""
    part = lambda k: F.get(F.split("output", "|".join(f"\\Q{m}\\E" for m in marks), -1), F.lit(k))
    return F.when(F.col("form") == "psm", F.concat(part(1), part(3), part(2))).when(F.col("form") == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col("output"))
