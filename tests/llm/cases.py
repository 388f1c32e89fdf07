"""Documents for small tests: nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, kept boolean, prefix string, blob string"


def frame(spark, texts, parts=3):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "src0" if (i or 0) % 2 else None, len(t or ""), -1, "x", None, "p", "b") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def awkward():
    """(doc_id, text) with every odd case, near and exact copies among them."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéß漢") for _ in range(rnd.randint(1, 7)))
    base = [[word() for _ in range(80)] for _ in range(4)]
    texts = [None, "", "  \n\t", "one", "two words", "  A  b\n\nC ", "\x1c\x85 a\tb", "x" * 5000, "ab " * 3000, "password = hunter22 and AKIA" + "Q" * 18, "don't I'll 123 ,,, 4.5"]
    for _ in range(60):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            w[rnd.randrange(80)] = word()
        texts.append(" ".join(w[: rnd.choice([80, 80, 80, 30])]))
    texts.append(" ".join(word() for _ in range(20_000)))
    return list(enumerate(texts))


EMPTY: list = []
