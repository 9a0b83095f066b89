import random
from itertools import combinations

import corpus_pipeline

from lodestack.llm import similar

SCHEMA = "doc_id long, text string"


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def _texts():
    """30 documents, each with copies that have 1 to 5 of 100 words changed."""
    random.seed(3)
    out = {}
    for k in range(30):
        words = [f"w{random.randrange(5000)}" for _ in range(100)]
        for n in range(6):
            changed = list(words)
            for at in random.sample(range(100), n):
                changed[at] = f"x{k}y{n}z{at}"
            out[10 * k + n] = " ".join(changed)
    return out


def _brute(texts):
    least = {i: i for i in texts}
    links = [(a, b) for a, b in combinations(sorted(texts), 2) if a // 10 == b // 10 and jaccard(texts[a], texts[b]) >= 0.8]
    for _ in texts:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least, links


def test_stage_drops_copies_of_similarity_08(spark, small):
    texts = _texts()
    least, links = _brute(texts)
    assert len(links) > 60 and len(set(least.values())) > 30
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, small).collect()}
    assert kept == set(least.values())


def test_a_large_group_is_one_component(spark):
    """Copies of one text that differ in a word each, beside unlike texts."""
    words = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join(words[:at] + [f"x{i}"] + words[at + 1 :])) for i in range(400) for at in [7 * i % 150]]
    rows += [(1000 + i, " ".join(f"v{i}u{k}" for k in range(80))) for i in range(50)]
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 + i for i in range(50))


def _cluster(n=260):
    """A loose group: each text changes 0 to 24 of 120 words, many lie about the similarity."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    out = {}
    for i in range(n):
        mine = list(words)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 6, 12, 24])):
            mine[at] = f"x{rng.randrange(40)}"
        out[i] = " ".join(mine)
    return out


def test_blocks_find_what_pairs_find(spark):
    """Components of a loose group are those of all pairs, with blocks of any size."""
    texts = _cluster()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in texts.items()}
    least = {i: i for i in texts}
    links = [(a, b) for a, b in combinations(texts, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(40):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    parts = len(set(least.values()))
    assert 10 < parts < len(texts)
    for rows in (similar.BLOCK_ROWS, 7):
        got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs, block_rows=rows).collect()}
        # A pair at the similarity shares no band with a probability of 0.003.
        assert sum(got[i] != least[i] for i in texts) <= 2


def test_one_block_by_hand():
    import numpy as np
    import pyarrow as pa

    sets = [similar.shingles(" ".join(f"w{k}" if k != at else f"x{at}" for k in range(200)).encode()) for at in (500, 20, 90, 150)]
    sets.append(similar.shingles(" ".join(f"v{k}" for k in range(200)).encode()))
    keys, prints = zip(*map(similar.describe, sets))
    keys = np.array(keys)
    keys[:, 0] = 7  # all meet under the first key
    columns = {"key": [7] * 5, "i": [0] * 5, "j": [0] * 5, "side": [0] * 5, "band": [0] * 5, "node": [10, 11, 12, 13, 14], "s0": [int(p[0]) for p in prints], "s1": [int(p[1]) for p in prints], "part": [10, 11, 11, 13, 14], "keys": keys.tolist(), "grams": [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]}
    links = similar.block_links(pa.table(columns), 0.8)
    joined = {frozenset(x) for x in links}
    assert len(joined) == 2 and not any(14 in x for x in joined)
    assert similar.block_links(pa.table(columns | {"part": [1] * 5}), 0.8) == []


def test_simhash_finds_pairs_that_share_no_band(spark):
    """Pairs at 0.804 within three bits of 64, drawn so that no band of minima joins them."""
    rows = []
    for k, seed in enumerate((86597, 91205, 155549, 38977, 43171)):
        r = random.Random(seed)
        words = [f"w{r.randrange(10**6)}" for _ in range(50)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:12] + ["x"] + words[13:]))]
    keys = [similar.describe(similar.shingles(text.encode()))[0] for _, text in rows]
    assert all(jaccard(a, b) >= 0.8 for (_, a), (_, b) in zip(rows[::2], rows[1::2])) and not any((a == b).any() for a, b in zip(keys[::2], keys[1::2]))
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}
