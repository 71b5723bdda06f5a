from pyspark.sql import functions as F

from pointloom.llm import langid

EN = ["the house is on the hill and the cat sleeps", "we have been there before the rain came", "this was the only thing that they wanted"]
DE = ["das haus steht auf dem hügel und die katze schläft", "wir waren schon dort bevor der regen kam", "dies war das einzige was sie wollten"]


def docs(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([(t, "en") for t in EN * 3] + [(t, "de") for t in DE * 3])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_words_then_ngrams(spark):
    d = docs(spark)
    model = langid.fit(d, F.lit(True))
    assert model.languages == ["de", "en"]
    assert model.predict("the cat")[0] == "en"
    assert model.predict("katzen schlafen")[0] == "de"  # unseen words go by their n-grams
    for text in (None, "", "123 !?", "§§"):
        assert model.predict(text) == ("und", 0.0)
    lang, score = model.predict("zzzz" * 50_000)
    assert lang in ("de", "en") and 0 <= score <= 1


def test_frame(spark):
    d = docs(spark)
    model = langid.fit(d, F.lit(True))
    got = langid.identify(d, model, ["doc_id"]).collect()
    assert all(r.lang_pred == ("en" if r.doc_id < 9 else "de") for r in got) and len(got) == 18
    assert langid.identify(d.limit(0), model, ["doc_id"]).count() == 0
    none = langid.fit(d.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(d, none, ["doc_id"]).collect()} == {"und"}


def test_whole_text_counts(spark):
    model = langid.fit(docs(spark), F.lit(True))
    pre, s, e = next(langid.words("Ab, cdé"))
    assert len(s) == 2
    assert len(langid.grams(pre, s, e, 3)[0]) == 2 + 3
