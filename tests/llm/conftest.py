import random
import re

import pytest

WORDS = "the of and to in that is with for from quick brown lazy river stone table window garden paper yellow green open close".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages, repeats, nulls, and odd characters."""
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(1, 160)) for _ in range(40)]
    passage = sentence(rng, 60)
    out = list(base) + base[:6]
    for i in range(8):
        w = base[10 + i].split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(sentence(rng, 20) + " " + passage + "\n" + sentence(rng, 10))
    big = sentence(rng, 300).split()
    for i in range(12):  # near copies of one text that aren't all near each other
        w = list(big)
        for _ in range(10):
            w[rng.randrange(len(w))] = f"x{i}"
        out.append(" ".join(w))
    out += ["", None, " \t\n", "one", "One", "one two three four", "ONE TWO three four", "é" * 60 + " ünï 𝒳 " * 30, passage * 3, "a" * 5000, "z " * 3000]
    return out


@pytest.fixture()
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture()
def odd(spark):
    """Null and repeated ids, null texts, repeated rows, and columns with the names that operators use."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, None), (3, None), (3, "other words here"), (4, "")]
    extra = {"kept": "K", "n_words": 7, "_text": "T", "_kinds": "k", "secrets": "s", "row": 1, "_row": "r", "size": 2, "rep": 3, "th": 4, "ranges": "q", "n_chars": 5, "_c": 6, "_d": 8, "key": 9, "lang": "en", "source": None}
    schema = "doc_id long, text string, " + ", ".join(f"`{k}` {'string' if v is None or isinstance(v, str) else 'long'}" for k, v in extra.items())
    return spark.createDataFrame([(*r, *extra.values()) for r in rows], schema)
