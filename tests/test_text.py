import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text as TX
from cohortlens.operators import text as T


def col(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_strip_lower_cut(spark):
    rows = [("  Héllo World \t",), ("   ",), ("",)]
    assert col(spark, rows, "t string", TX.clean_text("t", 0, 5)) == ["héllo", "", ""]


def test_split_words_like_python(spark):
    rows = [("  a b  c ",), ("",), ("   ",)]
    out = col(spark, rows, "t string", TX.split_words("t"))
    assert out == [s.split() for s, in rows]


def test_center_text(spark):
    text = "one two three four five six"
    pos = text.index("four")
    def ref(s, p, c):
        l, r = s[0:p].split(), s[p:].split()
        return l[-c:] + r[0:1 + c]
    for c in (0, 1, 2, 10):
        out = col(spark, [(text, pos)], "t string, p int", TX.center_text("t", F.col("p"), c))
        assert out[0] == ref(text, pos, c)
    assert col(spark, [("abc", 0)], "t string, p int", TX.center_text("t", F.col("p"), 2))[0] == ["abc"]


def test_keyword_snippets(spark):
    docs = spark.createDataFrame([(1, "The cat and the dog"), (2, "no match"), (3, "dog dog")], "id int, t string")
    out = sorted((r.id, r.keyword, r.position, r.snippet) for r in
                 T.keyword_snippets(docs, "t", ["the", "dog", "Dog"], id_col="id", num_chars=3).collect())
    d1 = "the cat and the dog"
    assert out == [(1, "dog", 16, d1[13:29]), (1, "the", 0, d1[0:13]), (3, "dog", 0, "dog dog"[0:13])]
    words = T.keyword_snippets(docs, "t", ["and"], id_col="id", num_words=1).collect()
    assert words[0].snippet == "cat and the"


def _weights_ref(tokens, kws, c, fixed=False):
    hits = [i for i, t in enumerate(tokens) if any(k in t for k in kws)]
    out = []
    for j in range(len(tokens)):
        if not hits:
            out.append(0.0)
            continue
        d = min(abs(j - h) for h in hits)
        if fixed:
            out.append(1.0 if d <= c else 0.0)
        else:
            out.append(1.0 if d == 0 else max(0.0, 1 - (d - 1) / c))
    return out


def test_keyword_weights_against_brute_force(spark):
    cases = [["a", "the", "b", "c", "d", "e", "there", "f"], [], ["x"], ["the"] * 3, ["a"] * 30 + ["the"] + ["b"] * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, tokens array<string>")
    for c, fixed in ((2, False), (3, True), (10, False)):
        out = {r.id: r.weights for r in TX.with_keyword_weights(df, "tokens", ["the"], c, fixed).collect()}
        for i, t in enumerate(cases):
            assert [round(x, 12) for x in out[i]] == [round(x, 12) for x in _weights_ref(t, ["the"], c, fixed)]


def test_tokenize_modes(spark):
    rows = [("Hello, World! It's 3.5",)]
    assert col(spark, rows, "t string", TX.tokenize("t", "clean"))[0] == ["hello", "world", "it", "s", "3", "5"]
    assert col(spark, rows, "t string", TX.tokenize("t", "wos"))[0] == ["Hello", ",", "World", "!", "It", "'", "s",
                                                                         "3", ".", "5"]
    assert col(spark, rows, "t string", TX.tokenize("t", "low_wos"))[0][0] == "hello"


def test_sorted_index_and_vocab(spark):
    words = ["b", "a", "é", "ab", "b", "zz", "Z", "aa"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    out = {r.word: r.id for r in T.sorted_index(df, "word", start=2).collect()}
    expect = {w: i + 2 for i, w in enumerate(sorted(set(words), key=lambda s: s.encode("utf-8")))}
    assert out == expect


def test_tfidf_three_sentences(spark):
    docs = ["the cat sat", "the dog sat down", "a cat"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, text string")
    d = T.tfidf_prepare(df, "text")
    model = T.tfidf_fit(d, "tfidf_tokens", None)
    out = {(r.id, r.term): r.tfidf for r in T.tfidf_long(model, d, "id", "tfidf_tokens").collect()}
    # reference computation: smooth idf, raw tf, l2 norm; 'a' has one letter: not a token
    toks = [[w for w in s.split() if len(w) >= 2] for s in docs]
    n = len(docs)
    vocab = sorted({w for t in toks for w in t})
    idf = {w: math.log((1 + n) / (1 + sum(w in t for t in toks))) + 1 for w in vocab}
    for i, t in enumerate(toks):
        w = {x: t.count(x) * idf[x] for x in set(t)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for x, v in w.items():
            assert math.isclose(out[(i, x)], v / norm, rel_tol=1e-12)
    vec = T.tfidf_vectors(model, d, "tfidf_tokens").orderBy("id").first().features
    assert math.isclose(float(vec.norm(2)), 1.0, rel_tol=1e-12)


def test_accent_folding(spark):
    assert col(spark, [("Naïve Café ﬁn",)], "t string", T.tfidf_text(F.col("t"))) == ["naive cafe fin"]


def test_token_ids_and_oov(spark):
    df = spark.createDataFrame([(1, ["a", "b", "q"]), (2, [])], "id int, tokens array<string>")
    vocab = T.vocabulary(spark.createDataFrame([(1, ["b", "a"])], "id int, tokens array<string>"), "id", "tokens")
    assert {r.word: r.id for r in vocab.collect()} == {"<PAD>": 0, "<UNK>": 1, "a": 2, "b": 3}
    out = {r.id: (r.ids, r.mask, r.length) for r in T.token_ids(df, "id", "tokens", vocab).collect()}
    assert out == {1: ([2, 3, 1], [1, 1, 1], 3), 2: ([], [], 0)}
    assert [r.word for r in T.oov_words(df, "tokens", vocab).collect()] == ["q"]


def test_sentence_vectors(spark):
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vec array<float>")
    df = spark.createDataFrame([(1, ["a", "b", "zz"], [1.0, 0.5, 1.0]), (2, ["zz"], [1.0])],
                               "id int, tokens array<string>, w array<double>")
    m = {r.id: r.embedding for r in T.sentence_vectors(df, "id", "tokens", vec, 2).collect()}
    assert m == {1: [2.0, 3.0], 2: [0.0, 0.0]}
    s = {r.id: r.embedding for r in T.sentence_vectors(df, "id", "tokens", vec, 2, weights_col="w").collect()}
    assert s == {1: [2.5, 4.0], 2: [0.0, 0.0]}
    c = {r.id: r.embedding for r in T.sentence_vectors_concat(df, "id", "tokens", vec, 2, 3).collect()}
    assert c == {1: [1.0, 2.0, 3.0, 4.0, 0.0, 0.0], 2: [0.0] * 6}


@pytest.mark.parametrize("weights", [None, "w"])
def test_sentence_vectors_of_a_large_table_sort_no_tokens(spark, monkeypatch, weights):
    """Vectors too large to broadcast: the tokens run past a hash table, and no aggregate sorts them."""
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -4.0]), ("n", None)], "word string, vec array<float>")
    rows = [(i, ["a", "b", "zz", "a"][: i % 5], [1.0, 0.5, 1.0, 2.0][: i % 5]) for i in range(200)] + [(None, ["a"], [1.0]), (7, ["n", "b"], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, w array<double>")
    small = sorted((r.id is None, r.id or 0, r.embedding) for r in T.sentence_vectors(df, "id", "tokens", vec, 2, weights_col=weights).collect())
    at = sorted((r.id is None, r.id or 0, r.pos, r.vec or []) for r in T.sentence_vector_rows(df, "id", "tokens", vec).collect())
    monkeypatch.setattr(T, "VECTOR_BYTES", 0)
    out = T.sentence_vectors(df, "id", "tokens", vec, 2, weights_col=weights)
    got = sorted((r.id is None, r.id or 0, r.embedding) for r in out.collect())
    assert got == small and len(got) == 202 and (False, 5, [0.0, 0.0]) in got
    want = {None: [5 / 3, 0.0], "w": [1 + 1.5 + 2, 2 - 2 + 4.0]}[weights]
    assert next(e for _, i, e in got if i == 4) == pytest.approx(want)
    both = T.sentence_vector_rows(df, "id", "tokens", vec)
    assert sorted((r.id is None, r.id or 0, r.pos, r.vec or []) for r in both.collect()) == at
    for frame in (out, both):
        plan = frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "ShuffledHashJoin [token" in plan and "ObjectHashAggregate" not in plan and "SortMergeJoin [token" not in plan


def test_lemmatize(spark):
    df = spark.createDataFrame([(1, ["cats", "dog", "cats"])], "id int, tokens array<string>")
    lem = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    assert T.lemmatize(df, "id", "tokens", lem).first().lemmas == ["cat", "dog", "cat"]


def test_bert_frame(spark):
    out = col(spark, [(["a", "b", "c"],)], "t array<string>", TX.bert_frame(F.col("t"), 4))
    assert out == [["[CLS]", "a", "b", "c"]]


PORTER_CASES = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "hesitanci": "hesit", "digitizer": "digit", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous",
    "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular",
    "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}


def test_porter_published_examples():
    from cohortlens.functions.stem import stem
    bad = {w: (stem(w), s) for w, s in PORTER_CASES.items() if stem(w) != s}
    assert not bad


def test_stem_tokens(spark):
    df = spark.createDataFrame([(1, ["running", "cats", "running"]), (2, [])], "id int, tokens array<string>")
    out = {r.id: r.stems for r in T.stem_tokens(df, "id", "tokens").collect()}
    assert out == {1: ["run", "cat", "run"], 2: []}


def test_bpe_encode_and_tokens(spark):
    from cohortlens.functions.bpe import encode
    ranks = {("l", "o"): 0, ("lo", "w"): 1, ("e", "r"): 2}
    assert encode("lower", ranks) == ["low", "er"]
    assert encode("x", ranks) == ["x"] and encode("", ranks) == []
    df = spark.createDataFrame([(1, ["lower", "low"]), (2, [])], "id int, tokens array<string>")
    merges = spark.createDataFrame([("l", "o", 0), ("lo", "w", 1), ("e", "r", 2)], "a string, b string, rank int")
    out = {r.id: r.subwords for r in T.bpe_tokens(df, "id", "tokens", merges).collect()}
    assert out == {1: ["low", "er", "low"], 2: []}
    words = spark.createDataFrame([("abab", 2), ("ab", 1)], "word string, n long")
    top = T.learn_merges(words, "word", "n", rounds=2, per_round=1).collect()
    # the second round merges what the first has merged
    assert [(r.a, r.b, r["rank"]) for r in top] == [("a", "b", 0), ("ab", "ab", 1)]


def test_map_tokens_both_ways(spark):
    df = spark.createDataFrame([(1, ["a", "b", None, "zz", "a"]), (2, []), (3, None)], "id int, tokens array<string>")
    table = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "n")], "token string, v string")
    want = {1: ["x", "y", None, "zz", "x"], 2: [], 3: []}
    small = {r.id: r.o for r in T.map_tokens(df, "id", "tokens", table, "v", None, "o").collect()}
    assert small == want
    joined = {r.id: r.o for r in T.map_tokens(df.where("id < 3 and id > 1"), "id", "tokens", table, "v", None, "o", max_bytes=0).collect()}
    assert joined == {2: []}
    full = spark.createDataFrame([(1, ["a", "b", "zz", "a"])], "id int, tokens array<string>")
    assert T.map_tokens(full, "id", "tokens", table, "v", F.lit("?"), "o", max_bytes=0).first().o == ["x", "y", "?", "x"]
    assert T.map_tokens(full, "id", "tokens", table, "v", F.lit("?"), "o").first().o == ["x", "y", "?", "x"]


def test_pad_ids(spark):
    df = spark.createDataFrame([(1, [5, 6, 7], [1, 1, 1]), (2, [], [])], "id int, ids array<bigint>, mask array<int>")
    out = {r.id: (r.ids, r.mask) for r in T.pad_ids(df, 2).collect()}
    assert out == {1: ([5, 6], [1, 1]), 2: ([0, 0], [0, 0])}


def test_stems_and_pieces_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, ["running", None, "cats", "running"]), (1, ["cats"]), (None, []), (3, None)], "id int, tokens array<string>")
    merges = spark.createDataFrame([("c", "a", 0), ("ca", "t", 1)], "a string, b string, rank int")
    stems, pieces = T.stem_tokens(df, "id", "tokens"), T.bpe_tokens(df, "id", "tokens", merges)
    assert sorted(map(str, (r.stems for r in stems.collect()))) == sorted(map(str, [["run", None, "cat", "run"], ["cat"], [], []]))
    assert sorted(map(str, (r.subwords for r in pieces.collect()))) == sorted(map(str, [[*"running", "cat", "s", *"running"], ["cat", "s"], [], []]))
    for out in (stems, pieces):
        lines = out._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in lines and "Exchange" not in lines and "Join" not in lines
    # words that were a table of over 32 MB before go where the texts lie
    long = spark.range(3).select(F.col("id"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.repeat(F.lit("q"), 40), i.cast("string"))).alias("tokens"))
    assert {len(r.stems) for r in T.stem_tokens(long, "id", "tokens").collect()} == {100}


def test_texts_go_to_python_in_short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        T.tfidf_prepare(spark.createDataFrame([("Ab",)], "text string"), "text")
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)
