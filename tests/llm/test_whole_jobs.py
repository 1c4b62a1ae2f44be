"""The registered operators do the whole job: on small tables where a cut would show."""

from rulespark.llm import entry, jaccard, language


def test_lm_scoring_looks_further_back_than_one_word(spark, tmp_path):
    """Two texts with the same pairs of adjacent words, of which only one is like the training texts."""
    rows = [(i, "a b a c a") for i in range(40)] + [(i, "a c a b a") for i in range(40, 45)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.score for r in entry.op7_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(found) == 45 and found[0] > found[40] + 0.1


def test_texts_that_share_an_id_are_compared_apart(spark, base_text):
    """Id 1 has two texts, each with a near copy, id 2 has one with a copy and one like no other; ids 3 and 5 repeat texts."""
    words = lambda seed: [f"{w}{i}" for i, w in enumerate(base_text(seed, 60).split())]
    a, b, c, d, e = (words(500 + i) for i in range(5))
    near = lambda w: " ".join([*w, "more"])
    a, b, c, d, e, near_a, near_b = *(" ".join(w) for w in (a, b, c, d, e)), near(a), near(b)
    rows = [(1, a), (1, b), (10, near_a), (11, near_b), (2, c), (2, d), (0, c), (3, e), (3, e), (5, ""), (5, " "), (5, e + " 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect())
    assert found == [(0, 0, 1), (1, 1, 1), (1, 1, 1), (2, 0, 1), (2, 2, 0), (3, 3, 2), (3, 3, 2), (5, 3, 2), (5, 5, 0), (5, 5, 0), (10, 1, 1), (11, 1, 1)]
    assert sorted((r.a, r.b) for r in jaccard.link_classes(df).collect()) == [(1, 10), (1, 11), (3, 5)]
    kept = sorted((r.doc_id, r.text.strip()) for r in jaccard.keep_one(df).collect())
    assert kept == sorted([(1, a), (1, b), (2, d), (0, c), (3, e), (5, "")])


def test_all_labelled_languages_are_fitted(spark):
    """70 languages of words of their own; the last has the fewest texts, and one id stands on many rows."""
    word = lambda x, i: "".join(chr(97 + (x * 7 + i * 5 + k * (x % 11 + 1)) % 26) for k in range(7))
    name = lambda x: f"{chr(97 + x // 26)}{chr(97 + x % 26)}"
    rows = [(100 * x + i, " ".join(word(x, i + k) for k in range(8)), name(x)) for x in range(70) for i in range(1 if x == 69 else 2)]
    rows += [(0, rows[0][1], name(0))] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, most_docs=2)
    assert model.languages == tuple(name(x) for x in range(70))
    once = language.fit(df.distinct(), most_docs=2)
    assert (model.table == once.table).all()
    plain = model.table[:, :-1].max(axis=0) - model.table[:, :-1].min(axis=0)
    assert plain.min() > 0  # each language has counts
