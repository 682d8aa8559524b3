"""Small documents with every awkward case, and brute-force versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, id long, size string, key string, h1 string, kept string"
_words = ["the", "of", "and", "Haus", "été", "niño", "alpha", "beta", "gamma", "delta", "über", "日本", "x", "!!", "12", "it's"]


def prose(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(_words) + rng.choice(["", "", rng.choice("abcdefgh") * rng.randint(1, 3)]))
        if i % 9 == 8:
            out[-1] += ".\n" if rng.random() < 0.5 else ","
    return " ".join(out)


SHARED = "This line stands in a good many of the documents here.\n"


def texts():
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    passage = prose(2, 70)
    out = [None, "", " ", "\n", "one", "One  two\tthree", "a\x00b\x00", base, base, base, " ".join(near), " ".join(near[:-2]), prose(3, 40) + passage + prose(4, 40), prose(5, 30) + passage, passage + " " + prose(6, 20)]
    out += [SHARED + prose(7 + i, 15) + "\n  " + SHARED.upper() + prose(30 + i, 9) for i in range(4)]
    out += ["spam " * 300, "%%% ### $$$ " * 60, "z" * 700, prose(50, 3000), prose(51, 3000) + prose(50, 200), "<|endoftext|> and <|STARTOFTEXT|> text<|endoftext|>x", "ab" * 300, "Größe İstanbul ΣΑΣ é"]
    return out


def rows():
    """Documents with clashing extra columns; null ids and sources, and a repeated row."""
    out = [(i * 3, t, ["en", "de", "fr", None][i % 4], ["b", "a", None, "é"][i % 4], None if t is None else len(t), "x", i, "y", "k", "h", "no") for i, t in enumerate(texts())]
    return [*out, (None, "no id", "en", "a", 5, "x", 99, "y", "k", "h", "no"), out[12]]


def frame(spark, some=None, parts=3):
    return spark.createDataFrame(rows() if some is None else some, COLUMNS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def unique_rows():
    """The rows with distinct ids."""
    return rows()[:-1]
