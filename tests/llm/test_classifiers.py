import math
import re
import zlib

import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from lodestack.llm import language, toxicity

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    got = language.query(spark, MEDIUM)
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert got.count() == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_language_edges(spark):
    text = {"en": "the cat and the dog went over the hill with what they had ", "fr": "le chat et le chien sont partis avec ce que nous avions pour la nuit "}
    rows = [(i, t * 3 + str(i), k) for i, (k, t) in enumerate(list(text.items()) * 10)] + [(90, None, "en"), (91, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? \n"), (4, "the cat went over the hill"), (4, "the cat went over the hill"), (5, "le chien est parti pour la nuit"), (None, "the dog"), (6, "x" * 200_000), (7, "é")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {(r.doc_id): r for r in language.identify(asked, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[1].rejected
    assert got[4].lang_pred == "en" and got[5].lang_pred == "fr" and not got[4].rejected
    assert got[7].lang_pred in ("en", "fr") and got[7].rejected
    assert language.identify(asked, model).count() == 9
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(asked, none).collect()} == {"und"}
    assert language.identify(asked.limit(0), model).count() == 0


def test_only_letters_count():
    model = language.LanguageModel({"en": b"the cat and the dog", "fr": b"le chat et le chien"})
    assert [model.classify(t)[0] for t in ("½ ² ①", "Ⅷ 12", "_", "٣")] == ["und"] * 4
    assert all(model.classify(t)[0] != "und" for t in ("a", "ß", "漢", "ª", "א"))


def test_languages_by_plain_zstandard(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    parameters = zstandard.ZstdCompressionParameters(**language._PARAMETERS)
    some = docs.filter("doc_id < 80")
    for r in language.identify(some, model).join(some, "doc_id").collect():
        data = r.text.lower().encode()
        sizes = {}
        for name, own in model.dictionaries.items():
            raw = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[name] = sum(len(zstandard.ZstdCompressor(compression_params=parameters, dict_data=raw).compress(data[i : i + 2048] + b"\x02" * 64)) for i in range(0, len(data), 2048))
        best, second = sorted(sizes.values())[:2]
        if regex.search(r"\p{L}", r.text):
            assert sizes[r.lang_pred] == best and r.rejected == ((second - best < 4 and second - best < 0.01 * best) or second == best)
            assert r.score == pytest.approx(1 / sum(2.0 ** -min(s - best, 60) for s in sizes.values()))


def test_null_ids_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "the cat and the dog", "en"), (1, "le chat", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for module in (language, toxicity):
        assert {r.held_out for r in module.query(spark, str(tmp_path)).collect() if r.doc_id is None} == {False}


def test_labels_do_not_reach_predictions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.fit(docs)
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(d, model).collect()) for d in (docs, docs.withColumn("lang", F.lit("zz"))))
    assert a == b


def test_held_out_toxicity(spark):
    got = toxicity.query(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    toxic, clean = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    area = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / len(toxic) / len(clean)
    assert area > 0.88 and sum(s >= 0.5 for s in clean) / len(clean) < 0.03 and sum(s >= 0.5 for s in toxic) / len(toxic) > 0.5


def _corpus():
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) + (f" {i} vile wretch q{i} you scoundrel z{i}" * 2 if i % 3 == 0 else "") for i in range(240)]
    return texts, [int(i % 3 == 0) for i in range(240)]


def test_toxicity_edges(spark):
    texts, toxic = _corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)) + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs.unionAll(docs), labels)
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "you vile wretch, you scoundrel, vile wretch"), (4, "a plain text of words"), (4, "a plain text of words"), (5, "plain words " * 40_000 + " vile wretch scoundrel"), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = toxicity.score(asked, model)
    by = {r.doc_id: r.score for r in got.collect()}
    assert got.count() == 7 and all(0 <= s <= 1 for s in by.values())
    assert by[3] > 0.5 > by[4] and by[1] == by[2] < 0.5
    nothing = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.score < 0.01 for r in toxicity.score(asked, nothing).collect()} == {True}
    assert toxicity.score(asked.limit(0), model).count() == 0
    assert len(toxicity.training_rows(docs.unionAll(docs), labels, 10)[0]) == 20


def test_scores_by_plain_zstandard(spark):
    """Every score again, from the dictionaries alone."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    some = docs.filter("doc_id < 60").withColumn("text", F.col("text"))
    got = {r.doc_id: r.score for r in toxicity.score(some, model).collect()}
    parameters = zstandard.ZstdCompressionParameters(**toxicity._PARAMETERS)
    size = lambda data, own: len(zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(data))
    asked = sorted(((r.doc_id, r.text) for r in some.collect()), key=lambda r: len(r[1]))[:3] + [(-1, None)]
    got[-1] = model.score(None)
    for doc_id, text in asked:
        own = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", "".join(c.lower() if c < "\x80" else c for c in text or "")).split(" ")
        own = [w for w in own if w]
        pairs = [f"   {'   '.join(own[i : i + 2])}   ".encode() + b"\x02" * 64 for i in range(max(1, len(own) - 1))]
        saved = [size(w, model.ordinary) - size(w, model.toxic) for w in pairs]

        def chance(saved, weights):
            n = len(saved)
            x = [1, math.log(n), *(math.log1p(sum(s >= k for s in saved)) for k in (1, 2, 3, 4, 5, 7)), *(math.sqrt(sum(s >= k for s in saved) / n) for k in (1, 2, 3, 4, 5, 7)), max(0, max(saved)), sum(saved) / n]
            return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights))))

        half = chance(saved[::2], model.weights[0])
        assert got[doc_id] == pytest.approx(half if half < 0.01 else chance(saved, model.weights[1]), abs=1e-9)


def test_dictionaries_are_running_text(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = {y: {b" ".join(p) for r in docs.join(labels, "doc_id").filter(F.col("toxic") == y).collect() for w in [toxicity.words((r.text or "").encode())] for p in zip(w, w[1:])} for y in (0, 1)}
    pieces = [b" ".join(p.split()) for p in model.toxic.split(b" " * 6)]
    assert len(model.toxic) > 2000 and len(model.ordinary) > 100_000
    assert sum(p in texts[1] for p in pieces if p.count(b" ") == 1) > 0.95 * sum(p.count(b" ") == 1 for p in pieces)


def test_weights_follow_the_real_class_sizes():
    """A class of which few rows were drawn keeps its share in the scores."""
    texts, toxic = _corpus()
    texts, toxic = [t.encode() for t in texts], [int(y and i % 2 == 0) for i, y in enumerate(toxic)]
    mean = lambda m: sum(m.score(t) for t in texts) / len(texts)
    even, rare = toxicity.train(texts, toxic), toxicity.train(texts, toxic, (20_000, 40))
    assert mean(rare) < mean(even)


@pytest.mark.parametrize("place", [0, 50_000, 99_000])
def test_the_whole_text_counts(place):
    texts, toxic = _corpus()
    model = toxicity.train([t.encode() for t in texts], toxic)
    text = " ".join(f"y{k}" for k in range(20_000)).encode()
    place = text.index(b" ", place)
    most = lambda t: model.saved(toxicity.windows(toxicity.words(t))).max()
    assert most(text[:place] + b" vile wretch scoundrel" + text[place:]) > most(text)


def test_no_window_is_left_out():
    """A clear text is compressed at its odd words too."""
    texts, toxic = _corpus()
    model = toxicity.train([t.encode() for t in texts], toxic)
    seen = []
    saved = model.saved
    model.saved = lambda of: seen.extend(of) or saved(of)
    clear = " ".join(f"calm{k} river{k}" for k in range(40)).encode()
    assert model.score(clear) < 0.01
    assert sorted(seen) == sorted(toxicity.windows(toxicity.words(clear)))


def test_what_is_remembered_equals_what_is_compressed(monkeypatch):
    """Also when words and slots run out and what was held is forgotten."""
    texts, toxic = _corpus()
    model = toxicity.train([t.encode() for t in texts], toxic)
    monkeypatch.setattr(toxicity, "_WORDS", 150)
    monkeypatch.setattr(toxicity, "_PIECE", 16)
    for text in [*texts[:12], *texts[:12], "", "one", "you vile you vile you vile"]:
        of = toxicity.windows(toxicity.words(text.encode()))
        want = toxicity.lengths(list(of), toxicity.compressor(model.ordinary)) - toxicity.lengths(list(of), toxicity.compressor(model.toxic))
        assert model.saved(of).tolist() == want.tolist()


def test_a_million_other_windows_are_not_forgotten(monkeypatch):
    """Windows of frequent words come back after many others."""
    asked = []
    for name in ("lengths", "_sizes"):
        monkeypatch.setattr(toxicity, name, lambda of, by: asked.append(len(of)) or np.zeros(len(of), np.int64), raising=False)
    model = toxicity.ToxicityModel(b"a" * 16, b"b" * 16, np.zeros((2, 16)))
    rng = np.random.default_rng(2)
    texts = [[b"w%d" % k for k in rng.integers(0, 3000, 20_000)] for _ in range(70)]
    for of in texts:
        model.saved(toxicity.windows(of))
    asked.clear()
    for of in texts[:5]:
        model.saved(toxicity.windows(of))
    assert sum(asked) / 2 < 0.2 * 100_000


def test_many_different_words_do_not_make_all_forgotten(monkeypatch):
    """Frequent windows are still held after 1.2 million words seen once."""
    asked = []
    monkeypatch.setattr(toxicity, "_sizes", lambda of, by: asked.append(len(of)) or np.zeros(len(of), np.int64))
    model = toxicity.ToxicityModel(b"a" * 16, b"b" * 16, np.zeros((2, 16)))
    frequent = [b"w%d" % k for k in np.random.default_rng(2).integers(0, 3000, 20_000)]
    model.saved(toxicity.windows(frequent))
    for i in range(60):
        model.saved(toxicity.windows([b"x%d" % k for k in range(i * 20_000, (i + 1) * 20_000)]))
    asked.clear()
    model.saved(toxicity.windows(frequent))
    assert sum(asked) / 2 < 0.2 * 20_000


def test_texts_together_score_as_each_alone(monkeypatch):
    """What texts share is compressed once; short, empty and null ones keep their places."""
    texts, toxic = _corpus()
    model = toxicity.train([t.encode() for t in texts], toxic)
    asked = [None, b"", b"one", *(t.encode() for t in texts[:9]), b"you vile", b"", *(t.encode() for t in texts[:9])]
    want = [toxicity.ToxicityModel(model.toxic, model.ordinary, model.weights).score(t) for t in asked[:4]] + [model.score(t) for t in asked[4:]]
    for least in (1, 150, 1 << 17):
        monkeypatch.setattr(toxicity, "_WORDS", least)
        assert toxicity.ToxicityModel(model.toxic, model.ordinary, model.weights).scores(iter(asked)) == want
    assert model.scores(iter([])) == []
    seen, sizes = [], toxicity._sizes
    monkeypatch.setattr(toxicity, "_sizes", lambda of, by: seen.append(len(of)) or sizes(of, by))
    toxicity.ToxicityModel(model.toxic, model.ordinary, model.weights).scores(t.encode() for t in texts[:9] * 3)
    assert seen == [len({p for t in texts[:9] for p in zip(toxicity.words(t.encode()), toxicity.words(t.encode())[1:])})] * 2


def test_few_slots_give_the_same_savings(monkeypatch):
    """Windows that drive each other out of their slots are compressed again."""
    monkeypatch.setattr(toxicity, "_sizes", lambda of, by: np.array([zlib.crc32(of[i].tobytes()) % 900 * (by == "ordinary") for i in range(len(of))]))
    known = toxicity._Known(17)
    for seed in (0, 1, 0):
        of = [b"w%d" % k for k in np.random.default_rng(seed).integers(0, 3000, 150_000)]
        got = known.saved(of, np.arange(len(of) - 1), ("toxic", "ordinary"))
        assert got.tolist() == [zlib.crc32(b"   %b   %b   " % p + b"\x02" * 64) % 900 for p in zip(of, of[1:])]
