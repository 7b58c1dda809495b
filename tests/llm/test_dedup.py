"""Jaccard join, substring and suffix deduplication against brute force."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pytest

from sextant.llm import jaccard, phrases, suffixes
from sextant.llm.wordhash import anchors, run_hashes, word_hashes

from .conftest import collected

VOCABULARY = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def near_copies(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return words


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies at several distances, shared passages, short, empty, null, very long and repeated rows."""
    rng = random.Random(5)
    rows, k = [], 0
    passage = prose(rng, 60)
    for _ in range(25):
        base = prose(rng, rng.choice([3, 8, 20, 60, 150]))
        for _ in range(rng.choice([1, 1, 2, 4])):
            words = near_copies(rng, base, rng.choice([0, 0, 1, 2, 5]))
            if rng.random() < 0.2:
                cut = rng.randrange(40)
                words = words + passage[cut:cut + rng.choice([20, 40, 60])] + words[:3]
            rows.append((k, rng.choice([" ", "  ", "\n"]).join(words)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, "One two  Three four five"), (k + 4, "one TWO three four five"),
             (k + 5, " ".join(prose(rng, 3000))), (None, rows[0][1]), (rows[1][0], rows[1][1]), (k + 6, "É é " * 30), (k + 7, "x" * 500)]
    return rows


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + min(n, len(words))]) for i in range(len(words) - min(n, len(words)) + 1)} if words else set()


def brute_components(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for (d, _), g in zip(rows, group) if g == group[i] and d is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc))
    return out


def by_nulls(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_jaccard_components(docs_of, corpus, n, num, den):
    found = jaccard.jaccard_components(docs_of(corpus), n=n, num=num, den=den)
    assert collected(found, "doc_id", "n_shingles", "component_id") == by_nulls(brute_components(corpus, n, num, den))


def test_jaccard_regions_that_are_too_large_are_cut(docs_of, monkeypatch):
    rng = random.Random(3)
    base = prose(rng, 120)
    rows = [(k, " ".join(near_copies(rng, base, rng.choice([1, 2, 6])))) for k in range(60)]
    monkeypatch.setattr(jaccard, "REGION_ROWS", 8)
    found = jaccard.jaccard_components(docs_of(rows), n=4, num=85, den=100)
    assert collected(found, "doc_id", "n_shingles", "component_id") == by_nulls(brute_components(rows, 4, 85, 100))


def test_jaccard_part_keys_meet_for_every_linked_pair():
    rng = np.random.default_rng(2)
    for num in (50, 80, 85, 95):
        radius = jaccard.Radius(num, 100)
        for _ in range(150):
            a = np.unique(rng.integers(0, 1 << 62, rng.integers(2, 120)).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 8)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and radius.links(common, len(a), len(b)) and len(a) + len(b) > 2 * common:
                assert np.intersect1d(jaccard.part_keys(a, radius), jaccard.part_keys(b, radius)).size


def test_jaccard_empty_table(docs_of):
    assert jaccard.jaccard_components(docs_of([], 1)).count() == 0


def brute_windows(rows, window):
    places = {}
    split = [(t or "").encode().split() for _, t in rows]
    for r, words in enumerate(split):
        for i in range(len(words) - window + 1):
            places.setdefault(tuple(words[i:i + window]), []).append((r, i))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for r, i in at:
                gone[r].update(range(i, i + window))
    return [(doc, len(words), len(g), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in g)).hexdigest())
            for (doc, _), words, g in zip(rows, split, gone)]


@pytest.mark.parametrize("window, chunk_bytes", [(35, 1 << 20), (12, 2000), (8, 500)])
def test_repeated_windows(docs_of, corpus, window, chunk_bytes):
    found = phrases.remove_repeated_windows(docs_of(corpus), window=window, chunk_bytes=chunk_bytes)
    assert collected(found, "doc_id", "n_words", "n_removed", "kept_sha256") == by_nulls(brute_windows(corpus, window))


def test_repeated_windows_text(docs_of):
    shared = " ".join(f"s{k}" for k in range(40))
    rows = [(0, f"a\n b {shared}  c\td"), (1, f"{shared} e"), (2, "f  g\n"), (3, None), (4, shared)]
    found = phrases.remove_repeated_windows(docs_of(rows), window=35, with_text=True)
    assert collected(found, "doc_id", "n_removed", "kept_text") == [(0, 40, "a\n b c\td"), (1, 40, "e"), (2, 0, "f  g\n"), (3, 0, None), (4, 40, "")]
    assert phrases.remove_repeated_windows(docs_of([], 1)).count() == 0


def test_repeated_windows_of_rows_without_an_id_or_of_one_id(docs_of, monkeypatch):
    rng = random.Random(12)
    passage, same = " ".join(prose(rng, 20)), " ".join(prose(rng, 60))
    rows = [(rng.choice([None, 7]), " ".join(prose(rng, 50)) + " " + rng.choice([passage, ""])) for _ in range(60)] + [(None, same)] * 80
    largest, locate = [], phrases.stored

    def stored(df, label):
        out = locate(df, label)
        if label == "located":
            largest.append(max(r["words"] for r in out.groupBy("chunk").agg({"n_words": "sum"}).withColumnRenamed("sum(n_words)", "words").collect()))
        return out

    monkeypatch.setattr(phrases, "stored", stored)
    found = phrases.remove_repeated_windows(docs_of(rows), window=12, chunk_bytes=1500)
    assert collected(found, "doc_id", "n_words", "n_removed", "kept_sha256") == by_nulls(brute_windows(rows, 12))
    assert largest[0] < sum(len(t.split()) for _, t in rows) / 5  # the 80 equal rows alone are more than half of all words


def brute_bytes(rows, length):
    distinct = sorted({((doc is not None, doc or 0), doc, (t or "").encode()) for doc, t in rows})
    seen, out = set(), {}
    for _, doc, data in distinct:
        cover = np.zeros(len(data) + 1, dtype=int)
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            if s in seen:
                cover[i] += 1
                cover[i + length] -= 1
            seen.add(s)
        gone = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[doc, data] = (doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return [out[doc, (t or "").encode()] for doc, t in rows]


@pytest.mark.parametrize("length, anchor_rows, chunk_bytes", [(100, 4096, 1 << 20), (40, 4096, 3000), (60, 2, 1 << 20)])
def test_repeated_bytes(docs_of, corpus, monkeypatch, length, anchor_rows, chunk_bytes):
    monkeypatch.setattr(suffixes, "ANCHOR_ROWS", anchor_rows)  # few places for a tree, so that blocks are joined up
    found = suffixes.remove_repeated_bytes(docs_of(corpus), length=length, chunk_bytes=chunk_bytes)
    assert collected(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == by_nulls(brute_bytes(corpus, length))


def brute_repeats(anchor, left, blobs, length):
    """(place, bytes before the anchor) of every whole string that a lower place has at the same distance from the same anchor."""
    seen, out = set(), set()
    for i, blob in enumerate(blobs):
        for step in range(left[i] + 1):
            s = blob[left[i] - step:left[i] - step + length]
            if len(s) == length:
                if (anchor[i], step, s) in seen:
                    out.add((i, step))
                seen.add((anchor[i], step, s))
    return out


def found_repeats(anchor, left, blobs, length):
    place, step, _ = suffixes.repeated_later(np.array(anchor, dtype=np.uint64), np.arange(len(anchor)), np.array(left), blobs, length)
    assert len(set(zip(place.tolist(), step.tolist()))) == len(place)
    return set(zip(place.tolist(), step.tolist()))


def test_repeats_of_many_anchors_of_different_left():
    rng = random.Random(8)
    length, gram, anchor, left, blobs = 24, 6, [], [], []
    for g in range(40):
        before, after = (bytes(rng.choice(b"ab") for _ in range(length)) for _ in range(2))
        most = rng.choice([0, 2, 7, 18])
        for _ in range(rng.choice([1, 2, 5])):
            a, least = rng.randint(0, most), rng.randint(0, 3)  # strings start from `a` down to `least` bytes before the anchor
            tail = bytearray(after)
            tail[rng.randrange(length)] = rng.choice(b"ab")
            anchor.append(g)
            left.append(a)
            blobs.append((before[length - a:] + b"%06d" % g + bytes(tail))[:a + length - min(least, a)])
    want = brute_repeats(anchor, left, blobs, length)
    assert len(want) > 100 and found_repeats(anchor, left, blobs, length) == want


def test_repeats_stay_when_the_end_of_the_order_leaves():
    same = bytes(range(65, 91)) * 6
    blobs = [same[:150], same[:150], same[:110], same[20:130]]
    assert found_repeats([1, 1, 2, 2], [50, 50, 10, 10], blobs, 100) == {(1, s) for s in range(51)}


def test_repeats_with_nul_bytes_where_a_shorter_place_ends():
    whole = b"b" * 12 + b"anchor" + b"\0" * 14
    assert found_repeats([1, 1, 1], [12] * 3, [whole, whole[:20], whole], 20) == brute_repeats([1, 1, 1], [12] * 3, [whole, whole[:20], whole], 20)
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randint(2, 9)
        anchor, left = [rng.randrange(2) for _ in range(n)], [rng.randint(0, 4) for _ in range(n)]
        blobs = [bytes(rng.choice(b"\0\0\0a") for _ in range(a + rng.randint(1, 8))) for a in left]
        assert found_repeats(anchor, left, blobs, 6) == brute_repeats(anchor, left, blobs, 6)


def test_repeated_bytes_of_periodic_texts(docs_of):
    rows = [(0, "ab" * 300), (1, "ba" * 150 + "c" + "ab" * 90), (2, "c" * 99), (3, "c" * 101), (4, "d" * 100), (5, "d" * 100 + "ab" * 60)]
    found = suffixes.remove_repeated_bytes(docs_of(rows))
    assert collected(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == by_nulls(brute_bytes(rows, 100))
    assert suffixes.remove_repeated_bytes(docs_of([], 1)).count() == 0


def test_anchors_are_the_least_of_their_stretch():
    rng = np.random.default_rng(4)
    values = rng.integers(1, 50, 200).astype(np.uint64)
    lengths = np.array([3, 0, 90, 7, 100])
    want = set()
    for first, n in zip(np.cumsum(lengths) - lengths, lengths):
        for i in range(n - 6):
            stretch = values[first + i:first + i + 7]
            want |= {int(first + i + k) for k in np.flatnonzero(stretch == stretch.min())}
    assert set(anchors(values, 7, lengths).tolist()) == want


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    from sextant.llm import wordhash
    text = b" ".join(str(k).encode() * 3 for k in range(5000))
    whole = word_hashes(text)
    monkeypatch.setattr(wordhash, "SLICE", 1000)
    assert (word_hashes(text) == whole).all() and len(whole) == 5000
    assert (run_hashes(whole, 4)[1000:1010] == run_hashes(whole[1000:1013], 4)).all()


def test_the_automaton_decides_what_goes(docs_of, monkeypatch):
    """Hashes only propose: windows that agree in all hashes but not in words stay, and nothing goes that the automaton does not find."""
    rng = random.Random(6)
    unlike = [(k, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60))) for k in range(12)]
    for k in range(1, 12):  # a recurring phrase in each, so that their windows are looked at
        unlike[k] = (k, unlike[k][1] + " " + " ".join(unlike[0][1].split()[20:30]) + "".join(f" e{k}x{j}" for j in range(40)))
    alike = [(20, unlike[0][1] + " tail"), (21, "head " + unlike[0][1])]
    found = phrases.remove_repeated_windows(docs_of(unlike + alike), window=35)
    assert {r["doc_id"] for r in found.collect() if r["n_removed"]} == {0, 20, 21}
    monkeypatch.setattr(phrases, "_window_hashes", lambda words, window: (
        np.zeros(max(len(words) - window + 1, 0), np.int64), np.zeros(max(len(words) - window + 1, 0), np.int32)))
    assert len(collected(phrases.remove_repeated_windows(docs_of(unlike[1:]), window=35).where("n_removed > 0"), "doc_id")) <= 1  # its own passage
    monkeypatch.undo()
    monkeypatch.setattr(phrases, "_automata", lambda passages, window: [SimpleNamespace(found=lambda words: np.zeros(len(words), dtype=bool))])
    assert collected(phrases.remove_repeated_windows(docs_of(unlike + alike), window=35).where("n_removed > 0"), "doc_id") == []


def test_passage_automaton_against_all_stretches():
    rng = random.Random(7)
    passages = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(12, 40))] for _ in range(6)]
    for _ in range(40):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(20)]
        p = rng.choice(passages)
        k = rng.randrange(len(p) - 11)
        words += p[k:k + rng.randrange(9, 16)] + [b"d"] + rng.choice(passages)[:12]
        want = np.zeros(len(words), dtype=bool)
        whole = {tuple(p[k:k + 12]) for p in passages for k in range(len(p) - 11)}
        for at in range(len(words) - 11):
            if tuple(words[at:at + 12]) in whole:
                want[at:at + 12] = True
        assert np.array_equal(phrases.PassageAutomaton(passages, 12).found(words), want)
