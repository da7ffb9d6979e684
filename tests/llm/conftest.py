import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names clash with what operators make."""
    from pagegauge.llm.base import ready

    ready(spark)

    def build(rows, extra=True):
        data = [(d, t, "en", f"s{(d or 0) % 2}", None if t is None else len(t)) for d, t in rows]
        df = spark.createDataFrame(data, DOC)
        if extra:
            for name in ("row", "key", "n", "keys", "n_words", "kept", "hits", "label", "node", "c"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    """Seeded sentences over a small vocabulary, with accents."""
    import random

    def text(seed, words, vocabulary=400):
        rng = random.Random(seed)
        known = ["".join(rng.choice("abcdeéüñß") for _ in range(rng.randint(1, 8))) for _ in range(vocabulary)]
        out = []
        for i in range(words):
            word = rng.choice(known)
            out.append(word.capitalize() if rng.random() < 0.2 else word)
            out.append(rng.choice([" ", " ", " ", "  ", "\n", "\t"]))
        return "".join(out)

    return text
