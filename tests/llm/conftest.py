import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = [a + b for a in ("the", "on", "Éa", "ing", "Zu", "re") for b in ("", "r", "na", "tion", "ß", "qu", "lo")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(id, text): originals, exact and near copies, shared passages and
    lines, short, empty, null and very long texts."""
    rng = random.Random(5)
    rows = [(i, "\n".join(sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    base = sentence(rng, 80)
    for i in range(40, 60):  # near copies of one text
        w = base.split(" ")
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "new" + str(i)
        rows.append((i, " ".join(w)))
    rows += [(60 + i, rows[i][1]) for i in range(6)]  # exact copies
    passage = sentence(rng, 40)
    rows += [(70 + i, sentence(rng, 10) + " " + passage + "\n" + sentence(rng, 12)) for i in range(5)]
    rows += [(80, ""), (81, None), (82, "   \n\t "), (83, "One"), (84, "one"), (85, "two words"), (86, "\n\n")]
    rows += [(90, "x" * 3000), (91, "abc " * 600), (92, sentence(rng, 4000)), (93, sentence(rng, 300) + passage)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, texts):
    """``texts`` with the columns of documents and columns whose names the
    operators use for their own."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t or ""), i, "x", i * 1.0, None)
            for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "id long, fp string, score double, kept string").repartition(3)
