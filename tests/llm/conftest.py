import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose with exact and near copies, shared lines, short, empty and null texts."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    common = prose(25)
    texts = ["\n".join(prose(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 5))) for _ in range(30)]
    for i in range(8):
        w = texts[i].split(" ")
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "EDIT" + str(rnd.randint(0, 99))
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[3].upper(), f"{prose(8)}\n{common}\n{prose(9)}", common, f"{common}\n{common}",
              "one", "one", "two words", "", "   \n\t ", None, None, prose(6000), "x" * 350, "ab " * 200]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return sorted(zip(ids, texts))


@pytest.fixture
def frame(spark):
    """Rows (doc_id, text) with columns that clash with the operators' own names."""
    def make(rows):
        return spark.createDataFrame(
            [(d, t, "a", 1, 2, b"k", "h") for d, t in rows],
            "doc_id long, text string, id string, n int, line int, key binary, hash string").repartition(3)

    return make
