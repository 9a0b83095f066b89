import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, vectors):
    """n_links and components over all pairs, in double precision."""
    unit = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        unit.append(None if x is None or not np.isfinite(x).all() or not np.linalg.norm(x) else x / np.linalg.norm(x))
    links = {i: set() for i in range(len(ids))}
    for i in range(len(ids)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                links[i].add(j)
                links[j].add(i)
    least = list(ids)
    for _ in ids:
        for i, near in links.items():
            least[i] = min([least[i], *(least[j] for j in near)])
    return {ids[i]: (len(links[i]), least[i]) for i in range(len(ids))}


def check(spark, ids, vectors, plan):
    rows = spark.createDataFrame(list(zip(ids, vectors)), SCHEMA).withColumn("v", F.lit(1)).withColumn("rep", F.lit(2))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(rows, plan).collect()}
    assert got == brute(ids, vectors)


@pytest.mark.parametrize("plan", [embeddings.CellPlan(), embeddings.CellPlan(cell_rows=20, block_rows=7), embeddings.CellPlan(cell_rows=8, block_rows=3, slack=2.0)])
def test_against_brute_force(spark, plan):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[k % 12] + rng.normal(size=16) * random.Random(k).choice([0.02, 0.1, 0.25])).astype(np.float32).tolist() for k in range(150)]
    vectors += [vectors[0]] * 9 + [[x * 4 for x in vectors[1]]]
    ids = list(range(500, 500 + len(vectors)))
    random.Random(1).shuffle(ids)
    check(spark, ids, vectors, plan)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0], [2.0, 0.0], [1e-30, 0.0], [3e38, 0.0], [-1.0, 0.0], [1.0, 0.0, 0.0]]
    check(spark, list(range(len(vectors))), vectors, embeddings.CellPlan())


def test_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0])], SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(3, 1, 3, True), (3, 1, 3, True), (None, 0, None, False)], key=str)
    assert embeddings.near_duplicates(rows.limit(0)).count() == 0


def test_rows_of_one_id_have_links_of_their_own(spark):
    rows = spark.createDataFrame([(3, [0.0, 1.0]), (3, None), (3, [1.0, 0.0]), (5, [0.0, 2.0]), (6, [0.0, 1.0]), (7, [1.0, 0.01])], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(rows).collect())
    assert got == sorted([(3, 2, 3), (3, 0, 3), (3, 1, 3), (5, 2, 3), (6, 2, 3), (7, 1, 3)])


def test_recall_on_the_test_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = spark.read.parquet(path).orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    plan = embeddings.CellPlan(cell_rows=50, block_rows=64)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.read.parquet(path), plan).collect()}
    assert [got[r.vec_id] for r in rows] == links.tolist()


@pytest.mark.parametrize("width", [4, 8, 16, 64])
def test_the_default_slack_finds_links_at_any_width(spark, width):
    """Pairs at the threshold, the hardest case, with small cells."""
    rng = np.random.default_rng(width)
    x = rng.normal(size=(600, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = rng.normal(size=(600, width))
    w -= (w * x).sum(axis=1)[:, None] * x
    w /= np.linalg.norm(w, axis=1)[:, None]
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * w
    both = np.concatenate((x, y)).astype(np.float32)
    exact = both.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1)[:, None]
    want = (exact @ exact.T >= 0.95).sum() - len(both)
    rows = spark.createDataFrame(list(enumerate(both.tolist())), SCHEMA)
    got = embeddings.near_duplicates(rows, embeddings.CellPlan(cell_rows=24)).agg(F.sum("n_links")).first()[0]
    assert want >= 1200 and 0.99 * want <= got <= want


def test_the_driver_gets_centres_and_no_sample(spark, monkeypatch):
    """The sample of a fit may be hundreds of MB; a task holds it."""
    got, to_arrow = [], type(spark.range(0)).toArrow

    def watched(frame):
        got.append(to_arrow(frame))
        return got[-1]

    monkeypatch.setattr(type(spark.range(0)), "toArrow", watched)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist(), i * 7919, i) for i in range(3000)], "rep long, v array<double>, h1 long, h2 long")
    centres = embeddings.fit_centres(rows, embeddings.CellPlan(cell_rows=100))
    assert centres.shape[1] == 8 and 5 < len(centres) <= 30
    assert sum(t.num_rows for t in got) <= 30
