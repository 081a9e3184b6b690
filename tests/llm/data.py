"""Small tables of documents with every awkward case, shared by the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def prose(seed: int, words: int, syllables=("ba", "ke", "lo", "mi", "tu", "ran", "sel", "vor")) -> str:
    r = random.Random(seed)
    out = []
    for k in range(words):
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        out.append(w + (".\n" if k % 23 == 22 else ""))
    return " ".join(out).replace("\n ", "\n")


def documents():
    """(doc_id, text, ...): copies, near copies, shared passages, null, empty, blank, one word, very long, odd characters."""
    passage = prose(99, 120)
    base = prose(1, 200)
    words = base.split(" ")
    near = " ".join(words[:50] + ["changed"] + words[51:])
    texts = [
        base, base, near, None, "", "   \n\t ", "word", "two words", prose(2, 300) + " " + passage + " " + prose(3, 50), prose(4, 100) + " " + passage,
        passage, "ab " * 900, prose(5, 6000), "Ünïcode ½² 日本語 — naïve space  double   triple\x1cend", "\x00zero", "don't we're I'll\n\n\nnew  <|endoftext|> end",
        "x" * 3000, prose(6, 60), prose(7, 90), base,
    ]
    rows = [(k, t, "aa" if k % 2 else "bb", "s", len(t or ""), 0.5) for k, t in enumerate(texts)]
    rows.append((5, rows[5][1], "aa", "s", 0, 0.5))  # a repeated row
    rows.append((None, "no id here at all", None, None, None, None))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
