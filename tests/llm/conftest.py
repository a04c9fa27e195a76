import random

import pytest

SYLLABLES = "ba de ki lo mu na pe ri so tu va ze".split()


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(n)]


def odd_texts() -> list[str | None]:
    """Null, empty, white, short, accented, repeated and long texts."""
    return [None, "", " \n\t ", "a", "Été à la plage\nÉTÉ", "x  y\n \n z    q", "<|endoftext|> is text", "<|x", "same words here now\n" * 30, " ".join(words(1, 40_000)), "\n".join(" ".join(words(s, 9)) for s in range(20)), "á \U0001f600 漢字", "end \n", "\n\n"]


@pytest.fixture(scope="session")
def documents(spark):
    """Odd texts, some rows twice, a null id, and columns whose names operators use within."""
    rows = [(i, t, "en", f"src{i % 3}", i, i, "x") for i, t in enumerate(odd_texts())]
    rows += [rows[8], rows[10], (None, "no id here", None, None, None, None, None), (100, "Same Words here now", "de", "src0", 1, 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k1 long, keep string")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
