import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelgrove.llm import reading

EASY = "The cat sat on the mat. We put the red cup on the bed. You can open the box. "
MIDDLE = "When the motor reaches about nine volts, the separate signal reduces the wheel again and the user checks the filter. "
HARD = "The monolithic polytetrafluoroethylene accelerometer is maintained by means of the electrodeposition, characterised in that a plurality of servomechanisms circumscribes the interchangeable configuration, wherein homogenisation energises the corresponding optosensor; "


def texts(n=20):
    rows = []
    for i in range(n):
        for level, t in ((1, EASY), (2, MIDDLE), (4, HARD)):
            rows.append((len(rows), t * (5 + i % 4), "en" if i % 2 else None, f"s{i % 3}", level))
    return rows


def words_of(*some):
    """A vocabulary of the words of some texts, all of rank 1 and 2."""
    got = reading._split([" ".join(some)])
    h = np.unique(got["word"])
    return reading.Words(h, np.arange(1, len(h) + 1), np.full(len(h), -3.0), np.full(len(h), 2.0), 2.0)


WORDS = words_of(EASY)


@given(st.lists(st.one_of(st.none(), st.text(max_size=120)), max_size=8))
@settings(max_examples=100, deadline=None)
def test_windows_of_any_text(many):
    text, n, number, x, count = reading.windows(many, WORDS)
    assert x.shape == (len(n), len(reading.FEATURES)) and np.isfinite(x).all() and len(count) == len(many)
    assert list(text) == sorted(text) and all(many[t] for t in text) and (n > 0).all() and set(text) == set(np.flatnonzero(count))
    for t in set(text):  # a text's features don't depend on its neighbours
        alone = reading.windows([many[t]], WORDS)[3]
        assert np.allclose(x[text == t], alone)


def test_window_features():
    text, n, number, x, count = reading.windows([EASY * 20, HARD * 20], WORDS)
    f = dict(zip(reading.FEATURES, x[text == 0].mean(0), strict=True))
    g = dict(zip(reading.FEATURES, x[text == 1].mean(0), strict=True))
    assert 2.5 < f["word_length"] < 3.5 < 6 < g["word_length"]
    assert f["sentence_length"] < 9 < 25 < g["sentence_length"] and f["longest_sentence"] < 9 < g["longest_sentence"]
    assert f["words_beyond_rank_50000"] == 0 < 0.5 < g["words_beyond_rank_50000"] and f["words_from_10_letters"] == 0 < g["words_from_10_letters"]
    assert count.tolist() == [len((EASY * 20).split()), len((HARD * 20).split())]


def test_windows_overlap_by_half_and_end_with_the_text():
    for words, sizes in ((1, [1]), (30, [30]), (31, [31]), (60, [60]), (61, [60, 31]), (100, [60, 60, 40])):
        _, n, number, _, _ = reading.windows(["cat " * words], WORDS)
        assert n.tolist() == sizes and number.tolist() == list(range(len(sizes)))


def test_markup_is_no_language():
    plain = reading.windows([EASY * 5], WORDS)[3]
    assert np.allclose(reading.windows(["&lt;sub&gt;" + (EASY * 5).replace("cup", "<b>cup</b>&nbsp;")], WORDS)[3], plain)


def test_bound_lies_between():
    assert 1.2 < reading.best_bound(np.array([1.0, 1.1, 1.2, 3.0]), np.array([2.0, 2.5, 3.5])) < 2.0
    assert reading.best_bound(np.array([1.0]), np.zeros(0)) == np.inf


def test_word_counts_cover_all_english_texts(spark):
    docs = spark.createDataFrame([(1, "a cat, A dog", "en", "s"), (2, "cat", None, "s"), (3, "cat", "de", "s"), (4, None, "en", "s")], "doc_id bigint, text string, lang string, source string")
    assert sorted(r.n for r in reading.word_counts(docs).collect()) == [1, 2, 2]
    words = reading.vocabulary(docs, 2)
    assert sorted(words.ranks) == [1, 2] and len(words.hashes) == 2


def test_trees_learn_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = np.sin(6 * x[:, 0]) + 3 * (x[:, 1] > 0.5)
    t = reading.BoostedTrees().fit(x[:1500], y[:1500])
    assert np.mean((t.predict(x[1500:]) - y[1500:]) ** 2) < 0.1 * y.var()
    knots = reading.isotonic(x[:, 0], y)
    assert (np.diff(knots[1]) >= 0).all() and (np.diff(knots[0]) >= 0).all()


def test_levels(spark):
    rows = texts()
    extra = [(1000, None, None, "s0", 0), (1001, "", "en", "s0", 0), (1002, "1.", "EN", "s1", 0), (1003, EASY * 9, "de", "s1", 0), (1004, "The cat sat.", "en-GB", None, 0), (1005, EASY * 12 + HARD * 12, None, "s2", 0), (1006, EASY * 3000, "En", "s2", 0)]
    docs = spark.createDataFrame([(*r[:4], 0.5) for r in rows + extra], "doc_id bigint, text string, lang string, source string, level double").repartition(3)
    labels = spark.createDataFrame([(r[0], r[4], "a") for r in rows] + [(rows[0][0], 1, "b"), (None, 2, "b"), (1003, 1, "b"), (5, None, "c")], "doc_id bigint, reading_level int, rater string")
    model = reading.fit(docs, labels)
    scored = reading.levels(docs, model)
    got = {r.doc_id: r for r in scored.collect()}
    assert set(got) == {r[0] for r in rows + extra} - {1003}
    assert got[1000].words == got[1001].words == got[1002].words == 0 and got[1000].level is None and got[1001].hardest is None
    assert np.mean([abs(got[r[0]].level - r[4]) < 0.5 for r in rows]) > 0.95
    easy = {r.doc_id for r in reading.easy_throughout(scored).collect()}
    assert easy >= {r[0] for r in rows if r[4] == 1} | {1006} and not easy & {1004, 1005, *(r[0] for r in rows if r[4] > 1)}
    assert sum(r.texts for r in reading.profile(scored).collect()) == len(got)
    assert model.report["texts"].sum() == len(rows)


def test_nothing_to_fit(spark):
    docs = spark.createDataFrame([(1, EASY, "en", "s")], "doc_id bigint, text string, lang string, source string")
    with pytest.raises(ValueError):
        reading.fit(docs, spark.createDataFrame([], "doc_id bigint, reading_level int, rater string"))
    model = reading.fit(docs, spark.createDataFrame([(1, 1, "a")], "doc_id bigint, reading_level int, rater string"))
    assert reading.levels(docs.limit(0), model).collect() == []
