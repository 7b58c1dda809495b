"""Token counts, quality, languages and packing against the libraries, brute force or held-out accuracy."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sextant.llm import language, packing, quality
from sextant.llm.packing import RemainingTree, best_fit_pack, best_fit_plan
from sextant.llm.token_counts import token_counts
from sextant.llm.tokenizing import id_encoder, length_encoder

from .conftest import collected

PIECE, BYTE_BPE, WORD_BPE = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", "a", " ", "  two  spaces ", "tabs\tand\nlines \n\n x", "<|endoftext|> inside<|endoftext|>", "</s> <s> <unk>", "▁ mark ▁▁ a▁ b", "can't we'll 'x' 12,345",
         "Ünïcödé été à la", "漢字 かな 한국어", "emoji 🙂🙂 👩‍👩‍👧", "a b c \u0085 d", "\x1c x\x1d", "nul\x00byte", "word " * 3000, "x" * 5000, "aé " * 500]
texts = st.text(alphabet=st.sampled_from("ab éA1 \n\t'▁.漢<|> \x1c"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_parts_encode_as_whole_texts(given_texts):
    piece, byte = sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(BYTE_BPE)
    assert length_encoder(PIECE).lengths(given_texts) == [len(piece.encode(t)) for t in given_texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in id_encoder(BYTE_BPE).ids(given_texts)] == [byte.encode(t, add_special_tokens=False).ids for t in given_texts]


def test_token_counts(docs_of):
    rows = [*enumerate(TEXTS), (90, None), (0, TEXTS[0]), (None, "no id")]
    for path in (PIECE, BYTE_BPE, WORD_BPE):
        if path == PIECE:
            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda t: len(piece.encode(t))
        else:
            model = Tokenizer.from_file(path)
            count = lambda t: len(model.encode(t, add_special_tokens=False).ids)  # noqa: E731,B023
        want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 400) for i, t in rows]
        found = token_counts(docs_of(rows), path, limit=400, batch_bytes=50)
        assert collected(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert token_counts(docs_of([], 1), PIECE).count() == 0


def simple_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_best_fit_plan_packs_as_piece_by_piece():
    rng = random.Random(1)
    for capacity in (1, 7, 64):
        for _ in range(60):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
            plan = best_fit_plan({n: lengths.count(n) for n in set(lengths)}, capacity)
            bins, ranks = {}, {}
            for length, a, b, first, per_bin, base in plan:
                for k in range(a, b):
                    at, place = first + (k - a) // per_bin, base + (k - a) % per_bin * length
                    bins.setdefault(at, []).append((place, length))
                    ranks.setdefault(length, []).append(k)
            assert all(sorted(r) == list(range(lengths.count(n))) for n, r in ranks.items()) and sum(map(len, ranks.values())) == len(lengths)
            for content in bins.values():
                content.sort()
                assert [p for p, _ in content] == np.cumsum([0, *(n for _, n in content)])[:-1].tolist()
            assert sorted(capacity - sum(n for _, n in c) for c in bins.values()) == simple_best_fit(lengths, capacity)


def test_remaining_tree():
    tree, marked, rng = RemainingTree(100), set(), random.Random(2)
    for _ in range(500):
        k = rng.randint(0, 100)
        on = rng.random() < 0.4
        tree.mark(k, on)
        (marked.add if on else marked.discard)(k)
        n = rng.randint(0, 100)
        assert tree.tightest(n) == min((m for m in marked if m >= n), default=None)


def test_packing_round_trip(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 4)
    rows = [*enumerate(TEXTS), (90, None), (0, TEXTS[0]), (None, "no id")]
    found = best_fit_pack(docs_of(rows), BYTE_BPE, capacity=64, end_id=2).collect()
    model = Tokenizer.from_file(BYTE_BPE)
    sequences, pieces = {}, {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for content in sequences.values():
        content.sort()
        assert [a for a, _ in content] == np.cumsum([0, *(n for _, n in content)])[:-1].tolist() and sum(n for _, n in content) <= 64
    for i, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert set(want) <= set(pieces[i])
    assert len(found) == sum(-(-(len(model.encode(t or "", add_special_tokens=False).ids) + 1) // 64) for _, t in rows)
    assert len(sequences) == len(simple_best_fit([r["length"] for r in found], 64))
    assert best_fit_pack(docs_of([], 1), BYTE_BPE).count() == 0


GOOD = "the river runs along the quiet valley and people walk there in the evening to see birds".split()


def labelled(n=400):
    rng, docs, labels = random.Random(7), [], []
    for k in range(n):
        good = k % 4 != 0
        words = [rng.choice(GOOD) for _ in range(rng.randint(20, 200))]
        docs.append((k, " ".join(words if good else [w.upper() + rng.choice(["!!", "$$$", "%%%"]) for w in words])))
        labels.append((k, int(good)))
    return docs, labels


def test_quality_classifier_on_the_held_out_fold(spark, docs_of):
    docs, labels = labelled()
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    model = quality.train(docs_of(docs), marks)
    rows = [*docs, (1000, None), (1001, ""), (None, "the river"), (3, docs[3][1]), (1002, docs[1][1] * 400)]
    found = quality.score(docs_of(rows), model, keep=["doc_id", "n_words"]).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    held = {r["doc_id"]: r for r in found if r["held_out"]}
    assert set(held) == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    truth = dict(labels)
    right = [r["predicted"] == truth[i] for i, r in held.items() if i in truth]
    assert np.mean(right) > 0.97
    assert {r["predicted"] for r in found if r["doc_id"] == 1002} == {1}


def test_quality_without_labels(spark, docs_of):
    model = quality.train(docs_of([(1, "a")]), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(docs_of([(1, "a"), (2, None)]), model).collect()] == [0.5, 0.5]


def test_language_on_the_held_out_fold(spark):
    rng = random.Random(3)
    words = {"en": "the and of with this that river people".split(), "fr": "le la des été où avec rivière gens".split(), "de": "der und nicht mit für straße menschen fluss".split()}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 60))), lang) for k, lang in enumerate(sorted(words) * 100)]
    extra = [(900, None, "en"), (901, "12 !!", "en"), (902, "", None), (None, "the river of people", "en"), (903, "été où " * 50_000, None), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string").repartition(3)
    model = language.train(docs, per_language=60)
    found = language.predict(docs, model).collect()
    assert len(found) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in found}
    held = [(by_id[i]["lang_pred"], lang) for i, _, lang in rows if by_id[i]["held_out"]]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.97
    assert by_id[900]["lang_pred"] == by_id[901]["lang_pred"] == by_id[902]["lang_pred"] == "und"
    assert by_id[903]["lang_pred"] == "fr" and by_id[None]["lang_pred"] == "en"
    assert (model.weights == 0).mean() > 0.5 and model.temperature > 0
    empty = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"}


def test_long_texts_are_counted_slice_by_slice(monkeypatch):
    text = "Été où la Rivière coule. " * 40
    whole = language.feature_counts(text)
    monkeypatch.setattr(language, "SLICE", 37)
    assert (language.feature_counts(text) == whole).all()


@pytest.mark.parametrize("n", [0, 1])
def test_end_token_of_empty_texts(docs_of, n):
    found = best_fit_pack(docs_of([(1, "")]), BYTE_BPE, capacity=8, end_id=2 if n else None)
    assert found.count() == n


def test_workers_keep_no_encoder_that_is_given_up(spark):
    import public_tokenizers

    from sextant.llm import packing
    from sextant.llm.tokenizing import id_encoder

    def held(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([id_encoder.cache_info().currsize] * batch.num_rows, pa.int32())], ["n"])

    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    kept = sorted(map(tuple, packing.best_fit_pack(docs, path).select("doc_id", "length", "ids_crc32").collect()))
    for _ in range(3):  # whichever worker kept one
        given = sorted(map(tuple, packing.best_fit_pack(docs, path, give_up=True).select("doc_id", "length", "ids_crc32").collect()))
    assert given == kept
    assert spark.range(64).repartition(4).mapInArrow(held, "n int").agg({"n": "max"}).first()[0] == 0
