import numpy as np
import pytest

from twinspark.operators import ivf, pairs


@pytest.fixture(scope="module")
def vectors(spark):
    """Forty directions, some of them common, one vector that many rows share, and null vectors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    rows = [(k, (centres[int(40 * rng.random() ** 2)] + 0.25 * rng.normal(size=12)).tolist()) for k in range(1500)]
    rows += [(k, rows[3][1]) for k in range(1500, 1600)] + [(9000, None)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").cache()


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return ivf.build(vectors, ivf.train(vectors, 32), f"file://{tmp_path_factory.mktemp('ivf')}/index")


@pytest.fixture(scope="module")
def exact(vectors):
    some = vectors.where("embedding is not null")
    return pairs.knn(some, some, 10, 6).select("id", "match_id").cache()


def test_every_vector_is_in_the_cell_of_its_nearest_centroid(spark, vectors, index):
    got = ivf.contents(spark, index).collect()
    assert len(got) == 1600 == index.sizes.sum()
    grid = np.floor(np.array([np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in got]) * ivf.SCALE)
    away = ((grid[:, None] - index.centroids[None]) ** 2).sum(2)
    assert [r["cell"] for r in got] == away.argmin(1).tolist()


def test_recall_in_few_cells(vectors, index, exact):
    found = ivf.search(vectors, index, 10, probe=4, digits=6)
    assert ivf.recall(found, exact) >= 0.9
    assert found.where("id = match_id and rank = 1 and distance <> 0").count() == 0
    assert found.groupBy("id").count().where("count > 10").count() == 0


def test_all_cells_give_the_exact_answer(vectors, index, exact, monkeypatch):
    monkeypatch.setattr(ivf, "PART", 37)  # cells and their queries meet in parts
    got = ivf.search(vectors, index, 10, probe=32, digits=6).select("id", "match_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect()))


def test_the_number_of_cells_that_is_enough(vectors, index):
    some = vectors.where("embedding is not null")
    n = ivf.probes_for(some, index, 10, 0.9, 100)
    assert 1 <= n <= 6
    assert ivf.probes_for(some, index, 10, 1.0, 100) >= n


def test_vectors_are_added(spark, vectors, tmp_path):
    some = vectors.where("id < 100")
    index = ivf.build(some, ivf.train(some, 4), f"file://{tmp_path}/index")
    more = ivf.add(index, vectors.where("id between 100 and 149"))
    assert more.sizes.sum() == 150 and ivf.contents(spark, more).count() == 150
    with pytest.raises(ValueError):
        ivf.train(vectors.limit(0), 4)
