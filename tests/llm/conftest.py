import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus.rows(), corpus.SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    own = [corpus.words(t) for t in corpus.texts()[:40]]
    items = [(k, " ".join(w[5:25]).translate(corpus.UPPER)) for k, w in enumerate(own) if len(w) > 30]
    return spark.createDataFrame([*items, (500, None), (501, ""), (502, "one two three"), (503, "--"), (items[0][0] + 600, items[0][1])], "item_id long, text string")
