import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the and ing tion ou er re st on en at ea ha sh bl wh ti th nd or".split()
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, row long, marks string, bucket int, _found string, taken long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def texts(seed=1):
    """doc_id -> text: plain, copies, near copies, shared passages, long, empty, white space and null ones."""
    rng = random.Random(seed)
    out = [sentence(rng, rng.randint(5, 120)) for _ in range(60)]
    out += out[:4] + [out[0]] * 3
    for base in out[4:16]:
        words = base.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = "edited"
        out.append(" ".join(words))
    passage = sentence(rng, 60)
    out += [f"{sentence(rng, rng.randint(3, 40))}\n{passage} {sentence(rng, rng.randint(0, 30))}" for _ in range(8)]
    out += [" ".join([passage, passage]), sentence(rng, 6000), "one", "Two words", "three little words", "a b c d", "", "   \n\t", None, None, "x\ty\x0bz  é è q 日本語 \U0001f600 end", "same line\nsame line\nother\nsame line", "# * $ % & | < >" * 20, "a " * 400]
    return dict(enumerate(out))


@pytest.fixture(scope="session")
def corpus():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 5}", len(t or ""), -1, "n", -2, "m", 0, "f", 7) for i, t in corpus.items()]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def repeated(spark):
    """Rows repeated whole, and a null doc_id."""
    row = lambda i, t: (i, t, "en", "s", 0, 0, "", 0, "", 0, "", 0)
    text = sentence(random.Random(9), 50)
    return spark.createDataFrame([row(1, text)] * 3 + [row(2, "other words here to read on and on")] * 2 + [row(None, text), row(None, None)], EXTRA)
