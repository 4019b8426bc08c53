"""A small table of awkward documents, and base rules written plainly."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __shard int, size string, key string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(seed=1, n=60):
    """Plain, near-copied, copied, repeated, empty, null, blank, unicode, symbol and very long documents."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        out.append([k, sentence(rng, rng.randint(5, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None])])
    for k in range(8):  # near copies and copies of document 3
        words = sentence(random.Random(99), 200).split()
        words[10 * k] = "changed"
        out.append([100 + k, " ".join(words), "en", "a"])
    out.append([120, out[60][1], "en", "a"])
    out.append([121, out[60][1], "fr", "b"])
    out += [[130, None, None, None], [131, "", "en", "a"], [132, " \n\t ", "en", "b"], [133, None, "en", "z"], [134, "one two", "en", "z"], [135, "one two", "en", "z"]]
    out.append([140, "café élémenté \U0001f600 naïve  double space\n\nlast " * 20, "fr", "a"])
    out.append([141, "### *** |||  $$$\n" * 30, "en", "b"])
    out.append([142, sentence(rng, 30_000), "en", "a"])
    out.append([143, "mail a.b@c.example.org or 10.0.0.255 call +1 (555) 010-2000 pay 4539 1488 0343 6467 now", "en", "a"])
    out.append([5, out[5][1], out[5][2], out[5][3]])  # a row twice
    out.append([None, "no id here but words enough", "en", "a"])
    return [(i, t, g, s, len(t or ""), 0, "size", "key") for i, t, g, s in out]


def docs(spark, data=None, parts=3):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
