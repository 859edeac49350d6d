"""Small documents with every odd case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, word string, key string, fp long"


def odd_documents():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = "A line that several of the documents SHARE, long enough"
    long_text = "\n".join(text(12) for _ in range(400))
    base = text(60)
    rows = [(k, f"{text(25)}\n{shared if k % 2 else shared.lower() + '  '}\n{text(3)}\n\n{text(30)}") for k in range(12)]
    rows += [(12, None), (13, ""), (14, "one"), (15, " \t\x0b\x0c\r\n "), (16, long_text), (17, long_text), (18, base), (19, base), (20, base + " end"), (None, shared), (None, None)]
    rows += [(21, base.upper()), (21, base.upper()), (22, "x" * 5000), (23, "ÀÉ\x1c\u00a0\u2003 b")]
    return [(i, t, "en", [None, "s1", "s2", "é", "S", ""][k % 6], None if t is None else len(t), -1, 5, "w", "k", 9) for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def simple(spark, rows):
    """(doc_id, text[, source]) rows."""
    return frame(spark, [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 0, 0, "", "", 0) for r in rows])
