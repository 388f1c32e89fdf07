import hashlib
import random
import re
import tracemalloc

import pytest

from tests.llm.cases import EMPTY, awkward, frame
from tidemark.llm import fill_in_middle as fim

MORE = [(300, "holds <M> a mark"), (301, "a\n\n\nb\r\nc"), (302, "\n"), (303, "x < S> <P y"), (304, "one line\n" * 4000), (305, "é漢\n" * 3 + "end"), (306, "<\n<S\nP>\n"), (304, "another text\nof one id")]


def brute(doc_id, text, units, percent, spm_percent, marks=fim.MARKS, seed=7):
    text = text or ""
    cut = re.findall(units, text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if text == "" or h[2] % 100 >= percent or any(m in text for m in marks):
        return len(cut), "plain", None, None, text
    a, z = sorted(x % (len(cut) + 1) for x in h[:2])
    p, m, s = "".join(cut[:a]), "".join(cut[a:z]), "".join(cut[z:])
    if h[3] % 100 < spm_percent:
        return len(cut), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return len(cut), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


@pytest.mark.parametrize(("units", "percent", "spm_percent"), [(fim.LINES, 100, 50), (r"\S+\s*|\s+", 60, 100), (r"(?s).", 100, 0)])
def test_against_whole_arrays_of_units(spark, units, percent, spm_percent):
    rows = [*awkward(), *MORE]
    out = fim.fill_in_middle(frame(spark, rows), units, percent=percent, spm_percent=spm_percent).withColumn("back", fim.restored()).collect()
    got = sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
    assert got == sorted((i, *brute(i, t, units, percent, spm_percent)) for i, t in rows)
    assert sorted((r["doc_id"], r["back"]) for r in out) == sorted((i, t or "") for i, t in rows)
    assert len({r["form"] for r in out}) == (2 if spm_percent in (0, 100) else 3)


def test_other_marks_and_nothing(spark):
    marks = ("[p.]", "|s|", "(m*)")
    out = fim.fill_in_middle(frame(spark, MORE), marks=marks).withColumn("back", fim.restored(marks)).collect()
    assert sorted((r["doc_id"], r["back"]) for r in out) == sorted(MORE) and all(r["form"] != "plain" for r in out)
    assert fim.fill_in_middle(frame(spark, [(1, "x")]).limit(0)).count() == len(EMPTY)
    assert fim.fill_in_middle(frame(spark, [(None, "x\ny"), (1, None)])).collect()[0].asDict() == {"doc_id": 1, "n": 0, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": ""}


def test_memory_does_not_grow_with_the_units():
    find, rnd = re.compile(fim.LINES).finditer, random.Random(1)
    text = "".join(rnd.choice(["a\n", "\n", "bcd\n"]) for _ in range(300_000))
    tracemalloc.start()
    n = fim.count_units(text, find)
    a, z = fim.unit_ends(text, find, n // 3, n - 5)
    assert tracemalloc.get_traced_memory()[1] < 20_000
    tracemalloc.stop()
    assert (text[:a].count("\n"), text[:z].count("\n")) == (n // 3, n - 5)
