import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd white space, other scripts, blanks, and one long text."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["été", "Straße", "漢字", "🙂x", "Don't", "A,B"]
    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = text(60)
    base = text(150)
    texts = [text(rng.randint(1, 120)) for _ in range(40)]
    texts += [base] * 6 + [base.upper(), base.replace(" ", "\n\t", 40)]
    for k in range(8):
        parts = base.split(" ")
        for _ in range(k * 3):
            parts[rng.randrange(len(parts))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(parts))
    texts += [text(30) + " " + passage + " " + text(30) for _ in range(12)]
    texts += [passage + "\x0b" + passage, "same " * 90, "", " \t\n", None, None, "one", "one two three four", text(5000)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with null ids, a repeated row, and columns whose names operators might use themselves."""
    rows = [(i, t, "en", "src", len(t or ""), "mine", 7) for i, t in corpus]
    rows += [(None, "a row without id", None, None, None, None, None), rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, id long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
