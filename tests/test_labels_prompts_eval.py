"""Labelling (A1-A3, W2), prompt packing (T7, U6) and evaluation."""

import math

import pytest
from pyspark.sql import functions as F

from sextant.functions.text import LABEL_PROMPT
from sextant.operators import evaluate as E
from sextant.operators import labels as L
from sextant.operators import prompts as P
from sextant.operators.inference import first_candidate_responder


def test_most_frequent_ties_noise_and_none(spark):
    rows = [(0, 1, "b-x"), (1, 1, "a-y"), (2, 1, "a-y"), (3, 1, "b-x"),   # tie: b-x first seen
            (4, 2, "NONE-NONE"), (5, 2, "book-NONE"),                     # all placeholders -> ''
            (6, -1, "c-z"), (7, -1, None)]                                # noise is labelled too
    df = spark.createDataFrame(rows, "id long, cluster_id int, candidate_intent string")
    got = {r["cluster_id"]: r["generated"] for r in L.label_most_frequent(df).collect()}
    assert got == {1: "b-x", 2: "", -1: "c-z"}
    top = {r["cluster_id"]: r["candidates"] for r in L.top_candidates(df, 3).collect()}
    assert top[1] == "b-x, a-y" and top[2] == ""


def test_majority_response_tie_goes_to_first_prompt(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "y"), (1, 3, "x"), (2, 0, "z")],
                               "cluster_id int, prompt_no int, response string")
    assert {r["cluster_id"]: r["generated"] for r in L.majority_response(df).collect()} == {1: "x", 2: "z"}


def test_dedup_keep_first(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "a")],
                               "cluster_id int, rank int, text string")
    got = sorted((r["cluster_id"], r["rank"], r["text"]) for r in L.dedup_keep_first(df).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a")]


def ref_pack(utts, cands, budget=512):
    """The original greedy loop, with an over-long first utterance emitted alone."""
    prompts, cur = [], []
    length = len(LABEL_PROMPT.split())
    i = 0
    while i < len(utts):
        u = utts[i]
        if cur and len((", " + u).split()) + length > budget:
            prompts.append(cur)
            cur, length = [], len(LABEL_PROMPT.split())
            continue
        cur.append(u)
        length = len((LABEL_PROMPT % (", ".join(cur), cands)).split())
        i += 1
    prompts.append(cur)
    return prompts


def _words(n, tag="w"):
    return " ".join(f"{tag}{k}" for k in range(n))


@pytest.mark.parametrize("case", ["budget", "over", "495", "496", "dups", "trailing_space"])
def test_pack_prompts_edges(spark, case):
    cands = "book-flight, cancel-order, find-hotel"
    utts = {
        "budget": [_words(200), _words(200), _words(80), _words(3)],   # fills up to exactly 512 words
        "over": [_words(200), _words(200), _words(81), _words(3)],
        "495": [_words(495), _words(1)],
        "496": [_words(496), _words(2), _words(700)],
        "dups": ["same text", "same text", "other"],
        "trailing_space": ["ends with space ", "", "next", "x " * 3],
    }[case]
    df = spark.createDataFrame([(7, k, u) for k, u in enumerate(utts)], "cluster_id int, rank long, text string")
    c = spark.createDataFrame([(7, cands)], "cluster_id int, candidates string")
    got = P.pack_prompts(df, c).orderBy("prompt_no").collect()
    want = ref_pack(utts, cands)
    assert [r["prompt"] for r in got] == [LABEL_PROMPT % (", ".join(p), cands) for p in want]
    for r, p in zip(got, want):
        assert r["n_utterances"] == len(p)


def test_prompts_as_written_out(spark):
    rows = [(1, 0, ""), (1, 1, "x"), (1, 2, "y"), (2, 0, "a"), (2, 1, ""), (2, 2, "b"), (3, 0, "")]
    utts = spark.createDataFrame(rows, "cluster_id int, rank long, text string")
    cands = spark.createDataFrame([(1, "p-q, r-s"), (2, "p-q")], "cluster_id int, candidates string")
    got = {r["cluster_id"]: (r["n_utterances"], r["prompt"]) for r in P.pack_prompts(utts, cands).collect()}
    tail = ". What is the best fitting intent, if any, among the following: "
    assert got == {1: (3, "Given these utterances: x, y" + tail + "p-q, r-s"), 2: (3, "Given these utterances: a, , b" + tail + "p-q"),
                   3: (1, "Given these utterances: " + tail)}


def test_label_by_prompt_uses_top_candidate(spark):
    rows = [(i, 1, f"utterance {i}", c) for i, c in enumerate(["a-b", "c-d", "c-d", "NONE"])] + \
           [(9, 2, "lonely", "NONE-x")]
    df = spark.createDataFrame(rows, "id long, cluster_id int, text string, candidate_intent string")
    got = {r["cluster_id"]: r["generated"] for r in P.label_by_prompt(df).collect()}
    assert got == {1: "c-d", 2: ""}
    assert first_candidate_responder(LABEL_PROMPT % ("u", "x-y, z-w")) == "x-y"


def test_readable_lookup(spark):
    t = E.readable_table(spark)
    df = spark.createDataFrame([("twacs", "BOOKFLT"), ("twacs", "OTHER"), ("atis", "atis_flight_no"),
                                ("snips", "BOOKFLT")], "dataset string, intent string")
    got = [r["readable"] for r in E.apply_readable(df, t).orderBy("dataset", "intent").collect()]
    assert sorted(got) == sorted(["book flight", "OTHER", "flight number", "BOOKFLT"])


def test_majority_intent_and_first_label(spark):
    df = spark.createDataFrame([(0, 1, "x", "g0"), (1, 1, "y", "g1"), (2, 1, "y", "g2"), (3, 1, None, "g3"),
                                (4, 2, None, "h")], "id long, cluster_id int, intent string, generated string")
    assert {r["cluster_id"]: r["most_common_gt"] for r in E.majority_intent(df).collect()} == {1: "y"}
    assert {r["cluster_id"]: r["generated"] for r in E.first_label(df).collect()} == {1: "g0", 2: "h"}


def test_average_per_intent_with_missing(spark):
    rep = spark.createDataFrame([(1, "a", 0.5), (2, "a", 1.0), (3, "b", 0.2)],
                                "cluster_id int, most_common_gt string, cosine_sim double")
    intents = spark.createDataFrame([("a",), ("b",), ("c",)], "intent string")
    per = {r["intent"]: r["cosine_sim"] for r in E.average_per_intent(rep, intents, "cosine_sim").collect()}
    assert per == {"a": 0.75, "b": 0.2, "c": 0.0}
    macro = E.macro_average(E.average_per_intent(rep, intents, "cosine_sim"), "cosine_sim").first()["avg"]
    assert math.isclose(macro, (0.75 + 0.2 + 0.0) / 3)


def test_token_logprob_padding_and_multi_ref(spark):
    toks = spark.createDataFrame([(1, 0, -1.0, False), (1, 1, -3.0, False), (1, 2, 0.0, True),
                                  (2, 0, -0.5, False)], "pair_id int, pos int, logprob double, is_pad boolean")
    got = {r["pair_id"]: r["score"] for r in E.mean_token_logprob(toks, ["pair_id"]).collect()}
    assert got == {1: -2.0, 2: -0.5}
    scores = spark.createDataFrame([(1, 0, -1.0), (1, 1, -3.0), (2, 0, -2.0), (2, 1, -2.5)],
                                   "src int, ref_no int, score double")
    assert {r["src"]: r["score"] for r in E.multi_ref_score(scores, "src", agg="max").collect()} == {1: -1.0, 2: -2.0}
    ragged = scores.where(~((F.col("src") == 2) & (F.col("ref_no") == 1)))
    with pytest.raises(ValueError):
        E.multi_ref_score(ragged, "src")
    with pytest.raises(NotImplementedError):
        E.multi_ref_score(scores, "src", agg="median")


def test_copy_scorer(spark):
    pairs = spark.createDataFrame([(1, "book a flight", "book flight")], "k int, src string, tgt string")
    lp = E.copy_scorer_logprobs(pairs, ["k"]).collect()
    want = [math.log(2 / (3 + E.SCORER_VOCAB))] * 2 + [math.log(1 / (3 + E.SCORER_VOCAB))]
    assert sorted(r["logprob"] for r in lp) == pytest.approx(sorted(want))


def _fold(utts, wc, budget):
    """(prompt_no, first, last, n, texts) by the sequential fold."""
    out, texts, n, cost, first = [], [], 0, 0, None
    for k, u in enumerate(utts):
        w = len(u.split())
        if any(texts) and 1 + w + 14 + wc + cost > budget:
            out.append((len(out), first, k - 1, n, ", ".join(texts)))
            texts, n, cost, first = [], 0, 0, None
        if not any(texts):
            texts, cost = [], 0
        texts.append(u)
        first, n, cost = (k if first is None else first), n + 1, cost + w + (not u or u[-1].isspace())
    return [*out, (len(out), first, len(utts) - 1, n, ", ".join(texts) if any(texts) else "")]


@pytest.mark.parametrize("by_join", [False, True])
def test_packing_by_ranges_equals_the_fold(spark, monkeypatch, by_join):
    import random

    monkeypatch.setattr(P, "BROADCAST_ROW_LIMIT", 0 if by_join else 1000)
    rng = random.Random(3)
    kinds = ["", "", " ", "a b ", "w", "w x y", "w " * 9, "v " * 40, "long " * 70]
    clusters = {c: [rng.choice(kinds).strip(" ") if rng.random() < 0.7 else rng.choice(kinds) for _ in range(n)] for c, n in ((1, 400), (2, 3), (3, 90))}
    clusters[4], clusters[5] = [""] * 120, [""] * 60 + ["w x"] + [""] * 60  # open over whole ranges
    rows = [(c, k, u) for c, us in clusters.items() for k, u in enumerate(us)]
    rng.shuffle(rows)
    utts = spark.createDataFrame(rows, "cluster_id int, rank long, text string")
    cands = spark.createDataFrame([(c, "p-q") for c in clusters], "cluster_id int, candidates string")
    got = P.pack_prompts(utts, cands, budget=60, range_rows=25).collect()
    want = [(c, *p) for c, us in clusters.items() for p in _fold(us, 1, 60)]
    found = [(r["cluster_id"], r["prompt_no"], r["first_rank"], r["last_rank"], r["n_utterances"],
              r["prompt"][len("Given these utterances: "):r["prompt"].rindex(". What is")]) for r in got]
    assert sorted(found) == sorted(want)


def test_batched_responder_reads_the_utterances(spark):
    from sextant.operators.inference import answer_prompts, best_matching_responder

    prompts = [LABEL_PROMPT % ("cancel my order, order", "book-flight, cancel-order"), LABEL_PROMPT % ("x", "a-b, c-d"), None, "no prompt", LABEL_PROMPT % ("x", "")]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(prompts)], "k int, prompt string").coalesce(1)
    got = [r["response"] for r in answer_prompts(df, best_matching_responder, batch_size=2).orderBy("k").collect()]
    assert got == ["cancel-order", "a-b", None, "", ""]


def test_words_counted_in_rows_give_the_same_scores(spark):
    from sextant.operators import evaluate as E

    long = " ".join(f"w{k % 7}" for k in range(60))
    rows = [(1, 0, "a b a", "a c"), (1, 1, "a b a", "b"), (2, 0, None, "a"), (2, 1, "x", None), (3, 0, "", ""), (4, 0, "a a", "a"), (4, 0, "b a", "b a"),
            (5, 0, long, long), (6, 0, "w1 </s> s", "w1"), (None, 0, "a", "a"), (7, 1, long, "w1 w2 z")]
    pairs = spark.createDataFrame(rows, "id long, ref_no int, src string, tgt string")
    keys = ["id", "ref_no"]

    def told(some, in_rows):
        lp = E.copy_scorer_logprobs(some, keys, in_rows=in_rows)
        return sorted((r["id"], r["ref_no"], r["pos"], round(r["logprob"], 12), r["is_pad"]) for r in lp.collect())
    assert told(pairs, True) == told(pairs, False)
    plain = pairs.where("id in (1, 2, 3, 6, 7)")
    assert told(plain, True) == told(plain, False)
    plan = E.copy_scorer_logprobs(plain, keys, in_rows=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # no word of a source is shuffled
