import random

from pyspark.sql import functions as F

from cohort.llm import toxicity as t

WORDS = "the a of river stone green walk table light song paper cloud under bright".split()


def corpus(n=900):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(5, 80))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "you", "grumfly", "IDIOT", "1diot"]))
            words.insert(0, rng.choice(["moron", "grumflying"]))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.fit(df, y.where(~held))
    assert any(s.startswith("grum") for s in model.learned)
    extra = spark.createDataFrame([(None, None, "x"), (5001, "", "x"), (5002, "you idiot " * 20_000, "x"), (5003, "river stone green " * 20_000, "x"), (0, docs[0][1], "x")], df.schema)
    out = model.score(df.unionByName(extra), "text", "p")
    assert out.columns == ["doc_id", "text", "score", "p"] and out.count() == len(docs) + 5
    rows = out.where(held).join(y, "doc_id").collect()
    right = sum((r.p >= t.THRESHOLD) == bool(r.toxic) for r in rows)
    assert right >= 0.95 * len(rows)
    p = {r.doc_id: r.p for r in out.where("doc_id IS NULL OR doc_id > 5000").collect()}
    assert p[5002] >= t.THRESHOLD > p[5003] and all(0 <= x <= 1 for x in p.values())


def test_too_few_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.p for r in t.fit(df, none).score(df, "text", "p").collect()] == [0.0, 0.0]
    odd = spark.createDataFrame([(1, 1), (1, None), (2, 7), (None, 1)], "doc_id long, toxic int")
    assert [r.p for r in t.fit(df, odd).score(df, "text", "p").collect()] == [1.0, 1.0]
    assert t.fit(df, none).score(df.limit(0), "text", "p").count() == 0


def test_features():
    def one(text):
        return dict(zip(t.FEATURES, t.features_of(text, {"grum": 3.0}, {}), strict=True))

    assert set(one(None).values()) == {0.0} and len(one("x")) == len(t.FEATURES)
    plain, hidden, masked = one("you are an idiot ok"), one("such a 1d10t here"), one("what a st*pid thing")
    assert plain["insults"] == 0.2 and plain["insults_near_you"] == 0.2
    assert hidden["hidden"] > 0 and masked["hidden"] > 0 and masked["masked"] > 0
    assert one("GRUMPY CAPS!!")["capitals"] == 1.0 and one("grumpy")["learned"] == 1.0
    diluted = one("word " * 5000 + "idiot moron scum " * 5)
    assert diluted["insults"] < 0.01 < diluted["worst"]


def test_features_of_each_token_plainly():
    """Lexicon features against a plain reading of each token, one after the other."""
    texts = ["you are an idiot", "1d10t! and st*pid", "such a " + "i" * 20 + "d" * 10 + "1" * 9 + "ooo" + "t" * 9, "c*wn cl*wn #diot " + "*" * 50, "A" * 60 + "#x", "fine words only", "crap! CRAP crap,"]
    for text in texts:
        got = dict(zip(t.FEATURES, t.features_of(text, {}, {}), strict=True))
        words = ["".join(c) for c in t._LETTERS.findall(text.lower())]
        plain = sum(w in t.INSULTS for w in words)
        hidden = masked = 0
        for token in {x.strip(t._EDGES) for x in text.lower().split()} if len(set(text.lower().split())) == len({x.strip(t._EDGES) for x in text.lower().split()}) else []:
            if len(token) < 3 or token.isalpha():
                continue
            fits = ("*" in token or "#" in token) and any(len(w) == len(token) and all(a in "*#" or a == b for a, b in zip(token, w, strict=True)) for w in t.INSULTS)
            masked += "*" in token or "#" in token
            hidden += fits or t.squeezed(token) in {t.squeezed(w) for w in t.INSULTS}
        assert got["insults"] * len(words) == plain, text
        if "crap" not in text:
            assert round(got["hidden"] * max(len(words), 1)) == hidden and round(got["masked"] * max(len(words), 1)) == masked, text
    long = dict(zip(t.FEATURES, t.features_of(texts[2], {}, {}), strict=True))
    assert long["hidden"] > 0


def test_few_labels_still_tell_texts_apart(spark):
    docs, labels = corpus(40)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = t.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.trees is not None  # eight toxic rows, in all five parts
    four = t.fit(df, spark.createDataFrame([r for r in labels if not r[1]] + [r for r in labels if r[1]][:4], "doc_id long, toxic int"))
    assert four.trees is None
    scores = {r.doc_id: r.p for r in four.score(df, "text", "p").collect()}
    insulting = {i: any(w in t.INSULTS for w in text.lower().split()) or "1diot" in text for i, text, _ in docs}
    assert sum(insulting.values()) >= 5 and all((scores[i] >= t.THRESHOLD) == insulting[i] for i, _ in labels)


def test_parts_have_both_labels(spark):
    docs, labels = corpus(60)
    rows = t._label_rows(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic", 1000)
    assert {(r.part, r.label) for r in rows.collect()} == {(p, y) for p in range(5) for y in (0, 1)}
