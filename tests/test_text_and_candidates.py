"""Text cleaners (T1-T3, T8) and candidate extraction (D1-D5, P5) on hand-built rows."""

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import candidates as C
from sextant.operators.tokens import TOKEN_SCHEMA, rule_annotate, token_heads


def _one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_normalize_text(spark):
    assert _one(spark, T.normalize_text, "Hello,  World!! ß é") == "hello world ß é"
    assert _one(spark, T.normalize_text, "a\tb  c") == "a\tb c"  # inner tabs survive, as with split(' ')


def test_word_count(spark):
    assert _one(spark, T.word_count, "  two  words\n") == 2
    assert _one(spark, T.word_count, "") == 0


def test_clean_generated(spark):
    assert _one(spark, T.clean_generated, "Book_Flight-now") == "book flight now"
    assert _one(spark, T.clean_generated, None) == ""


def test_clean_intent_pascal(spark):
    f = lambda c: T.clean_intent(c, True)
    assert _one(spark, f, "FindConnection") == "find connection"
    assert _one(spark, f, "Software Recommendation") == "software  recommendation"
    assert _one(spark, f, "None") == "none"
    assert _one(spark, f, "lowerThenUpper") == "then upper"  # text before the first capital is dropped
    assert _one(spark, f, "hue_lightoff") == ""
    assert _one(spark, f, "") == ""


def test_clean_intent_plain(spark):
    f = lambda c: T.clean_intent(c, False)
    assert _one(spark, f, "hue_lightoff") == "hue lightoff"
    assert _one(spark, f, "book-flight") == "book flight"


def _tok(i, text, pos, dep, head):
    return {"i": i, "text": text, "pos": pos, "dep": dep, "head": head}


def _tokens_df(spark, docs):
    rows = [(i, toks) for i, toks in enumerate(docs)]
    return spark.createDataFrame(rows, f"id long, tokens {TOKEN_SCHEMA}")


DOCS = [
    # 0: verb + object
    [_tok(0, "Book", "VERB", "", 0), _tok(1, "flight", "NOUN", "dobj", 0)],
    # 1: object left of the verb -> arc start is the noun: no action, object not at arc end
    [_tok(0, "software", "NOUN", "dobj", 2), _tok(1, "I", "PRON", "nsubj", 2), _tok(2, "use", "VERB", "", 2)],
    # 2: two objects, last wins; two compounds and one amod
    [_tok(0, "Delete", "VERB", "", 0), _tok(1, "old", "ADJ", "amod", 4), _tok(2, "mail", "NOUN", "compound", 4),
     _tok(3, "spam", "NOUN", "compound", 4), _tok(4, "account", "NOUN", "dobj", 0), _tok(5, "and", "CCONJ", "", 5),
     _tok(6, "Export", "VERB", "", 6), _tok(7, "Data", "PROPN", "dobj", 6)],
    # 3: negation on the verb
    [_tok(0, "not", "PART", "neg", 1), _tok(1, "delete", "VERB", "", 1), _tok(2, "files", "NOUN", "dobj", 1)],
    # 4: verb is xcomp of the negation's head
    [_tok(0, "do", "AUX", "neg", 1), _tok(1, "want", "VERB", "", 1), _tok(2, "change", "VERB", "xcomp", 1),
     _tok(3, "password", "NOUN", "dobj", 2)],
    # 5: no object at all
    [_tok(0, "hello", "INTJ", "", 0)],
]


def test_action_object_basic(spark):
    out = {r["id"]: r["candidate_intent"] for r in C.action_object(_tokens_df(spark, DOCS)).collect()}
    assert out[0] == "book-flight"
    assert out[1] == "NONE-NONE"
    assert out[2] == "export-account"  # slots taken from different arcs (last VERB start, last NOUN end)
    assert out[3] == "delete-files"
    assert out[5] == "NONE-NONE"


def test_pairs_with_modifiers_and_negation(spark):
    pairs = C.explode_pairs(_tokens_df(spark, DOCS)).collect()
    got = {(r["id"], r["pair_no"]): r["pair"] for r in pairs}
    assert got[(0, 0)] == "Book-flight"
    assert got[(1, 0)] == "use-software"
    assert got[(2, 0)] == "Delete-old_mail_spam_account"
    assert got[(2, 1)] == "Export-Data"
    assert got[(3, 0)] == "not_delete-files"
    assert got[(4, 0)] == "do_change-password"
    ext = {r["id"]: r["candidate_intent"] for r in C.action_object_ext(_tokens_df(spark, DOCS)).collect()}
    assert ext[2] == "Delete-old_mail_spam_account" and ext[5] == "NONE"


def test_array_form_equals_join_form(spark):
    df = _tokens_df(spark, DOCS)
    arr = df.select("id", F.posexplode(F.transform(
        F.filter("tokens", lambda t: t["dep"] == "dobj"),
        lambda o: F.concat_ws("-", C.action_phrase(F.col("tokens"), o), C.object_phrase(F.col("tokens"), o))))
        .alias("pair_no", "pair"))
    a = sorted((r["id"], r["pair_no"], r["pair"]) for r in arr.collect())
    b = sorted((r["id"], r["pair_no"], r["pair"]) for r in C.explode_pairs(df).collect())
    assert a == b


def test_keep_candidates(spark):
    df = spark.createDataFrame([(1, "book-NONE"), (2, "NONE-NONE"), (3, None), (4, "book-flight")],
                               "id long, candidate_intent string")
    assert sorted(r["id"] for r in C.keep_candidates(df).collect()) == [4]
    assert sorted(r["id"] for r in C.keep_candidates(df, nulls_as_candidates=True).collect()) == [3, 4]


def test_rule_annotator(spark):
    df = spark.createDataFrame([(0, "We are booking flights, nicht checking ticket locations. Next")],
                               "id long, text string")
    toks = rule_annotate(df).first()["tokens"]
    by_text = {t["text"]: t for t in toks}
    assert by_text["booking"]["pos"] == "VERB"
    assert by_text["flights"]["dep"] == "dobj" and by_text["flights"]["head"] == by_text["booking"]["i"]
    assert by_text["nicht"]["dep"] == "neg" and by_text["nicht"]["head"] == by_text["checking"]["i"]
    assert by_text["ticket"]["dep"] == "compound" and by_text["ticket"]["head"] == by_text["locations"]["i"]
    assert by_text["Next"]["dep"] == ""  # other sentence
    heads = token_heads(rule_annotate(df)).collect()
    assert {r["text"]: r["head_text"] for r in heads}["flights"] == "booking"


def test_extract_dispatch(spark):
    df = spark.createDataFrame([(0, "We are Ordering tickets")], "id long, text string")
    assert C.extract(df, "liu").first()["candidate_intent"] == "ordering-tickets"
    assert C.extract(df, "mine").first()["candidate_intent"] == "Ordering-tickets"
    try:
        C.extract(df, "unknown")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def _brute_hashed(texts, dim):
    import hashlib
    import math

    import regex

    out = {}
    for i, t in texts:
        counts = {}
        for w in regex.split(r"[^\p{L}\p{N}_]+", (t or "").lower()):
            if w:
                b = int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % dim
                counts[b] = counts.get(b, 0) + 1
        norm = math.sqrt(sum(c * c for c in counts.values()))
        out[i] = {b: (c, c / norm) for b, c in counts.items()}
    return out


def test_hashed_embedding_matches_brute_force(spark):
    from sextant.operators.embedding import hashed_counts, hashed_embedding

    dim = 16
    long_text = " ".join(f"w{k % 37}" for k in range(5000))
    texts = [(0, "Reset the password, reset it now!"), (1, ""), (2, None), (3, "éclair Überweisung naïve café"),
             (4, "a_b a-b a.b 42 42 42"), (5, "   "), (6, long_text)]
    texts += [(7 + k, f"item {k} of the batch item") for k in range(300)]
    df = spark.createDataFrame(texts, "id long, text string")
    want = _brute_hashed(texts, dim)
    got = {}
    for r in hashed_counts(df, dim).collect():
        got.setdefault(r["id"], {})[r["bucket"]] = (r["cnt"], r["weight"])
    assert set(got) == {i for i, cells in want.items() if cells}
    for i, cells in got.items():
        assert {b: c for b, (c, _) in cells.items()} == {b: c for b, (c, _) in want[i].items()}
        for b, (_, w) in cells.items():
            assert abs(w - want[i][b][1]) < 1e-12
    dense = {r["id"]: r["embedding"] for r in hashed_embedding(df, dim).collect()}
    assert set(dense) == {i for i, _ in texts}
    for i, vec in dense.items():
        assert len(vec) == dim
        for b in range(dim):
            assert abs(vec[b] - want[i].get(b, (0, 0.0))[1]) < 1e-12


def _rules(text):
    """The annotator's rules, word by word: (i, text, pos, dep, head)."""
    import re

    words = [(si, w.replace(",", "")) for si, s in enumerate(re.split(r"[.!?\n]", text)) for w in re.split(r"[ \t\n\x0b\f\r]+", s)]
    words = [(s, w) for s, w in words if w]

    def tag(w):
        low = re.sub("[\x85\u2028\u2029]$", "", w.replace("İ", "i̇").lower())
        for pos, suffixes in (("VERB", "ing ed er ir ar en"), ("NOUN", "tion ment s ung keit ción heit")):
            if len(w) >= 5 and low.endswith(tuple(suffixes.split())):
                return pos
        return "X"
    tags = [tag(w) for _, w in words]

    def verbs(lo, hi, s):
        return [j for j in range(max(lo, 0), min(hi, len(words) - 1) + 1) if tags[j] == "VERB" and words[j][0] == s]
    obj = [next(iter(verbs(k - 5, k - 1, s)[::-1]), None) if tags[k] == "NOUN" else None for k, (s, _) in enumerate(words)]
    out = []
    for k, (s, w) in enumerate(words):
        comp = [j for j in range(k + 1, min(k + 2, len(words) - 1) + 1) if obj[j] is not None and obj[j] < k]
        neg = verbs(k + 1, k + 3, s) if w.lower() in ("no", "pas", "nicht") else []
        dep, head = ("dobj", obj[k]) if obj[k] is not None else ("compound", comp[0]) if comp else ("neg", neg[0]) if neg else ("", k)
        out.append((k, w, tags[k], dep, head))
    return out


def test_rule_annotate_by_arrays(spark, monkeypatch):
    import random

    import pyarrow as pa

    from sextant.operators import tokens as N

    rnd = random.Random(5)
    bits = ["a", "running", "Walked", "Nations", "station,s", "no", "NICHT", "Pas", "CANCIÓN", "sauberKEIT", "runnİng", "éééés", "日本語日ing", "orders\u2028", "Zeitung\x85",
            ",", ".", "!", "?\n", "\t", "\r", "\x0b", "\x1cgoing", "😀😀ed"]
    texts = ["".join(rnd.choice(bits) + rnd.choice([" ", " ", ""]) for _ in range(rnd.randint(0, 30))) for _ in range(300)] + ["", " ", ","]
    arrays = pa.array([None, *texts, None])
    monkeypatch.setattr(N, "SLICE_BYTES", 200)
    got = pa.concat_arrays([N._tokens_of(p) for p in N._text_slices(arrays)]).to_pylist()
    assert got[0] is None and got[-1] is None
    assert [[tuple(t.values()) for t in ts] for ts in got[1:-1]] == [_rules(t) for t in texts]
    df = spark.createDataFrame(list(enumerate([None, *texts])), "id long, text string").repartition(3)
    rows = {r["id"]: r["tokens"] for r in rule_annotate(df).collect()}
    assert rows[0] is None and all([tuple(t) for t in rows[k]] == _rules(t) for k, t in enumerate(texts, 1))
    heads = token_heads(rule_annotate(df))
    assert heads._jdf.queryExecution().optimizedPlan().toString().count("run(text") == 1  # texts are annotated once


def test_first_pairs_by_arrays_equal_the_array_expressions(spark):
    import random

    from sextant.operators import candidates as C
    from sextant.operators.tokens import TOKEN_SCHEMA, rule_annotate

    rng = random.Random(5)
    word = ["running", "station", "no", "pas", "payment,", "houses.", "tall", "nicht", "Leitung", "hablar", "nación", "x", "\n"]
    texts = [None, "", " ", *(" ".join(rng.choices(word, k=rng.randrange(1, 40))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    new = C.action_object_ext(rule_annotate(df, read_once=True), by_arrays=True)
    assert "tokens" not in new.columns
    old = C.action_object_ext(rule_annotate(df))
    found = {r["id"]: r["candidate_intent"] for r in new.collect()}
    assert found == {r["id"]: r["candidate_intent"] for r in old.collect()}
    assert found[0] == found[1] == "NONE" and len(set(found.values())) > 50
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "_first_pairs(run(" in plan and "_first_pairs(tokens" not in plan  # tokens stay in the worker

    deps, rows = ["", "dobj", "compound", "amod", "neg", "xcomp"], []
    for i in range(200):
        n = rng.randrange(1, 12)
        rows.append((i, [(k, f"w{k}", "X", rng.choice(deps), rng.randrange(n)) for k in range(n)] if i % 20 else None))
    given = spark.createDataFrame(rows, f"id long, tokens {TOKEN_SCHEMA}")
    both = [{r["id"]: r["candidate_intent"] for r in C.action_object_ext(given, by_arrays=b).collect()} for b in (True, False)]
    assert both[0] == both[1]
