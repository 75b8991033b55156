import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n int, sid string, hash string, r int, extra string, doc string, hub int, kind string, ids string, norm string, fp int, rep int, gone string, gone_id string, gone_sha string, cut_id string, cut_spans string, predicted string, component_id string, kept string, text_sha256 string, __id string, __i string, __sha string, __spans string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text, lang) with more columns, whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), *["x", 1, "y", "z", 2, "e", "d", 3, "k", "i", "m", 4, 5, *"abcdefghijklm"]) for i, t, lang in rows], SCHEMA)

    return make


def prose(rng: random.Random, words: int, letters: str = "abcdefghijklmnop") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, short and very long texts, ties, repeated rows and near copies."""
    rng = random.Random(1)
    base = prose(rng, 300)
    words = base.split()
    near = " ".join(w if k % 150 else "changed" for k, w in enumerate(words))
    loop = "one two three four five six seven eight nine ten " * 3000
    rows = [(0, base, "en"), (1, base, "en"), (2, near, None), (3, None, "en"), (4, "", None), (5, " \n\t ", "de"), (6, "a b", "de"), (7, "A\x0bb", "de"), (8, loop, "en"), (9, loop + "end", "en"), (10, "!!! 123", "en"), (None, base, "en"), (None, None, None), (11, "été ▁ 日本 😀\x00 x", "fr"), (11, "été ▁ 日本 😀\x00 x", "fr"), (12, prose(rng, 40) + "\n" + " ".join(words[100:170]), "en"), (13, base.upper(), "en")]
    return rows + [(20 + k, prose(rng, rng.randint(1, 120)), "en") for k in range(30)]
