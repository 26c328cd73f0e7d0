import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, size string"

WORDS = "the of and to in tion ness ment able ing er ed un re pre con der die das und ist le la les des est".split()


def sentence(seed: int, n: int) -> str:
    """Made-up prose that is alike for alike seeds."""
    words, state = [], seed * 7919 + 17
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        word = WORDS[state % len(WORDS)] + WORDS[(state >> 8) % len(WORDS)]
        words.append(word if (state >> 16) % 7 else word + ".")
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""
    texts = [(i, sentence(i, 40 + i)) for i in range(20)]
    texts += [(100 + i, sentence(3, 43)) for i in range(4)]  # copies of 3
    texts += [(110, sentence(5, 45) + " more words here"), (111, "Start " + sentence(5, 45))]  # near copies of 5
    texts += [(120, None), (121, ""), (122, None), (123, "   \n\t "), (124, "one two"), (125, "one two"), (126, "One  TWO")]
    texts += [(None, sentence(8, 48)), (None, sentence(8, 48)), (None, None)]
    texts += [(130, sentence(30, 60)), (130, sentence(30, 60)), (130, sentence(31, 60))]  # repeated rows and ids
    texts += [(140, sentence(40, 6000)), (141, "é" * 3000 + " 𝒳𝒴 " + "x" * 5000)]
    sources = ["a", "b", None, "c", "é", ""]
    return [
        (i, text, "en", sources[n % len(sources)] if n % 3 else "a", None if text is None else len(text), "k", "s", "z")
        for n, (i, text) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "lang", "n_chars").persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
