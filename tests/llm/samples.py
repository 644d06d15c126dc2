"""Small tables for the tests of the corpus operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, row long, kept string, component long, `_x` int"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def words(text):
    """Reference form of the word rule: A-Z in lower case, white space of ASCII only."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def documents(seed=1, n=60):
    """Texts with exact and near copies, nulls, empty and long texts, ties, repeated rows, and null ids."""
    rnd = random.Random(seed)
    rows = [(i, prose(rnd, rnd.choice([1, 3, 5, 40, 120]))) for i in range(n)]
    base = prose(rnd, 60)
    for i in range(n, n + 12):  # near copies of one text
        parts = base.split()
        parts[rnd.randrange(60)] = f"new{i}"
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, "  " + rows[3][1] + "\n"), (202, rows[3][1].upper()), (203, None), (204, ""), (205, " \t\n"),
             (206, "x" * 5000 + " tail"), (207, prose(rnd, 9000)), (208, "ünï cödé   wörd 🙂"), (209, "tie a"), (210, "tie a"),
             (211, "same row"), (211, "same row"), (None, "no id"), (None, None), (212, "A  b\tc"), (-3, "a b C")]
    return [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}" if i != 7 else None, 7, "d", 1, 2, "k", 3, 4) for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
