"""The embedding hook with a provider made for the test."""

import pytest

from packaudit.functions import embedding


class Lengths:
    """Vectors that say how long a text is, how large its batch was, and how often this process has loaded a provider."""

    loaded = 0
    space, dimension = "lengths:v1", 3

    def __init__(self):
        Lengths.loaded += 1

    def embed(self, texts):
        return [[float(len(t)), float(len(texts)), float(Lengths.loaded)] for t in texts]


class Short(Lengths):
    space = "short:v1"

    def embed(self, texts):
        return [[1.0]] * len(texts)


def rows(spark):
    return spark.createDataFrame([(str(i), None if i == 7 else "x" * (i % 50)) for i in range(500)], "id string, text string").repartition(2)


def test_batches_are_bounded_and_the_model_loads_once(spark):
    found = embedding.embedded(rows(spark), Lengths, "lengths:v1", 3, most=16).collect()
    by = {r["id"]: r["embedding"] for r in found}
    assert len(by) == 500 and {r["embedding_space"] for r in found} == {"lengths:v1"}
    assert all(by[str(i)][0] == (0 if i == 7 else i % 50) for i in range(500))
    assert max(v[1] for v in by.values()) == 16 and {v[2] for v in by.values()} == {1.0}


def test_batches_are_bounded_by_bytes():
    assert [len(b) for b in embedding.batches(["é" * 10] * 5 + ["x" * 100, "y"], 64, 45)] == [2, 2, 1, 1, 1]
    assert list(embedding.batches([], 64, 10)) == []


@pytest.mark.parametrize("load, space, dimension", [(Lengths, "other:v1", 3), (Lengths, "lengths:v1-wide", 4), (Short, "short:v1", 3)])
def test_space_and_dimension_are_guarded(spark, load, space, dimension):
    with pytest.raises(Exception, match="provider is of|vectors for"):
        embedding.embedded(rows(spark), load, space, dimension).collect()


