import random

from brindle.llm import toxicity as X

DOCS = "doc_id long, text string, score string, toxic int"


def test_decoder_restores_masked_words(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text as t")
    model = X.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    for raw, word in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("stuuupid", "stupid"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("s.c.u.m", "scum"), ("w0rth1e55", "worthless"), ("pathetiiiic", "pathetic"), ("l0$er", "loser")):
        assert word in model.restored(f"the and {raw} of"), raw
        assert model.score(f"The ation {raw} of inger") >= 0.7
    assert model.score("The and attion to thanedble the, anea. Eriner thanea. 12 3rd a b c") < 0.3
    assert model.score("") < 0.3


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = X.score_toxicity(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    assert out.score.between(0, 1).all()
    assert out[out.toxic == 1].predicted.mean() > 0.75
    assert out[out.toxic == 0].predicted.mean() < 0.02


def test_viterbi_finds_the_cheapest_path():
    rng = random.Random(0)
    words = ["idiot", "dot", "tilt", "lid", "toil"]
    grams: dict[str, int] = {}
    for w in (f"^{x}$" for x in words):
        for k in (1, 2, 3, 4):
            for i in range(len(w) - k + 1):
                grams[w[i : i + k]] = grams.get(w[i : i + k], 0) + 1
    model = X.LetterModel(grams)

    def cost(path, signs):
        context, total = "^", 0.0
        for letter, sign in zip(path, signs):
            total += model.cost(context, letter) + (0.0 if letter == sign else 0.3)
            context = (context + letter)[-3:]
        return total + model.cost(context, "$")

    def paths(signs):
        if not signs:
            yield ""
            return
        for rest in paths(signs[1:]):
            for letter in X.LOOKALIKES.get(signs[0], signs[0]):
                yield letter + rest

    for _ in range(50):
        signs = "".join(rng.choice("1d0t!o") for _ in range(5))
        if any(a == b for a, b in zip(signs, signs[1:])):
            continue
        assert abs(cost(model.decode(signs), signs) - min(cost(p, signs) for p in paths(signs))) < 1e-9


def test_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    rows = [(i, f"nasty words {i}x" if i % 2 else f"kind things {i}x", "clash", 0) for i in range(200)] + [(1000, None, "", 0), (1001, "", "", 0), (None, "n4sty", "", 0), (1, "nasty words", "", 0), (1002, "*" * 50000, "", 0), (1003, "a b " * 30000, "", 0)]
    got = X.score_toxicity(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[1] == 1 and by[2] == 0 and by[1000] == 0 and by[1001] == 0 and by[None] == 1
    assert X.score_toxicity(spark.createDataFrame([], DOCS), labels).count() == 0
    assert {r.score for r in X.score_toxicity(spark.createDataFrame(rows, DOCS), labels.limit(0)).collect()} == {0.5}


def test_long_runs_take_linear_time():
    import time

    began = time.time()
    for text in ("a1" * 300_000, "aaab" * 150_000, "a.b" * 200_000, "a " * 300_000, "1" * 500_000):
        X.masked(text), X.stretched(text), X.joined(text), [m[0] for m in X.SPACED.finditer(text)]
    assert time.time() - began < 20
    assert X.stretched("a nooo b yesss") == {"nooo", "yesss"} and X.joined("x st-up_id y") == {"stupid"} and X.masked("the 1d10t!! of was%%% a") == {"1d10t"}


def test_word_breaks_signs_at_the_end_and_other_scripts(spark):
    d = "/root/testdata/sf0.1"
    model = X.fit(spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text as t"), spark.read.parquet(f"{d}/labels.parquet"))
    cases = (("such a m o r o n", "moron"), ("a i d i o t", "idiot"), ("i d i o t m o r o n", "moron"), ("i d i o t m o r o n", "idiot"), ("i  d  i\no \t t", "idiot"), ("idi07", "idiot"), ("idio+", "idiot"), ("1 d 1 0 t", "idiot"))
    for raw, word in cases:
        assert word in model.restored(raw), raw
        assert model.score(f"The ation {raw} of inger") >= 0.7
    assert "moron" in model.restored("i d i o t " * 12 + "m o r o n " + "i d i o t " * 12)
    assert X.masked("a$$ idi07 wow! page") == {"a$$", "idi07"}
    assert X.stretched("дуррррак οχιιι nooo no") == {"дуррррак", "οχιιι", "nooo"}


def test_every_labelled_row_counts(spark):
    """No bound on the labelled rows: the word of the twenty toxic ones among 10,400 is in the lexicon, and all letters are counted."""
    docs = spark.range(10_400).selectExpr("id AS doc_id", "concat(translate(cast(id AS string), '0123456789', 'abcdefghij'), ' plain', if(id % 520 = 0, ' zworp', '')) AS t")
    labels = spark.range(10_400).selectExpr("id AS doc_id", "cast(id % 520 = 0 AS int) AS toxic")
    model = X.fit(docs, labels, held_out=-1)
    assert "zworp" in model.features and model.letters.grams["^zwo"] == 20 and model.letters.grams["^pla"] == 10_400


def test_each_token_is_looked_at_once(spark, monkeypatch):
    """The look-alike searches see each different token once, not the whole text, and find what they find in the whole text."""
    rng = random.Random(3)
    features = {"idiot": 0.9, "idio*": 0.8, "stup*": 0.7, "moron": 0.6, "scum": 0.5}
    model = X.Model(X.LetterModel({"i": 9, "d": 5, "o": 8, "t": 7, "^i": 4, "^id": 4, "^idi": 4, "idio": 4, "diot": 4, "iot$": 4}), features, 0.1)
    pieces = ["1d10t", "i d i o t", "s.c.u.m", "stuuupid", "m-o-r-o-n", "idio+", "x.y", "a", "b,", "(c", "wow!", "it's", "é", "½", "the", "stu_pid.", "...", '"moron"', "m0r0n;", "\n", ".\n"]
    texts = [rng.choice(["", " "]).join(rng.choice(pieces) + rng.choice(["", " ", ". ", ", "]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    monkeypatch.setattr(X, "HELD_TOKENS", 50)
    for text in texts:
        lower, rest = text.lower(), 0.9
        for f in X.features_of(set(X.WORD.findall(lower)) | model.restored(lower) | X.joined(lower)) & features.keys():
            rest *= 1 - features[f]
        assert abs(model.score(text) - (1 - rest)) < 1e-12, text
    seen, whole = [], X.masked
    monkeypatch.setattr(X, "masked", lambda lower: seen.append(len(lower)) or whole(lower))
    model.score("kind w0rds here. " * 10_000)
    assert sum(seen) < 1000
