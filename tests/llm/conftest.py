import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with those of results."""

    def make(pairs):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        df = spark.createDataFrame(rows, DOC)
        extra = {"kept": "x", "rid": 1, "batch": 2, "node": 3, "component_id": 4, "n_words": 5, "labels": "y", "key": 6}
        from pyspark.sql import functions as F

        return df.withColumns({k: F.lit(v) for k, v in extra.items()})

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
