"""Substring deduplication with repeated-phrase automata.

A window of words that recurs holds a short phrase, its least by hash among
all phrases inside it, that recurs with it.  So phrases are counted over the
whole corpus first, then the windows around recurring phrases: those that
recur are confirmed.  One chunk of documents, the first that has a confirmed
window, cuts the passages of such windows out of its texts, in pieces of
bounded length; every chunk that has one of a passage's windows gets the
passage.

A chunk's passages are a shard: phrases at places that no window of theirs
can avoid are compiled into an Aho-Corasick automaton, through which the
chunk's documents are streamed.
Where a phrase is found, the document's words and the passage's are compared
to both sides, and a stretch of a window or more in common is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sextant.llm.common import as_bytes, by_bytes, byte_groups, give_back, result_schema, stored
from sextant.llm.wordhash import anchors, run_hashes, sliding, word_hashes
from sextant.session import bounded_broadcast

#: Words of a phrase.
PHRASE = 8
#: Windows of one piece of a passage.
PIECE_WINDOWS = 128
#: Words of the passages of one automaton.
SHARD_WORDS = 500_000
#: Bytes of text of one chunk, about.
CHUNK_BYTES = 2 << 20
#: Bytes of text that are hashed together.
GROUP_BYTES = 1 << 20


def _phrase_anchors(split: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the phrases that are the least in some window, over texts as lists of words."""
    n_words = np.array([len(w) for w in split], dtype=np.int64)
    hashes = run_hashes(word_hashes(b" ".join(chain.from_iterable(split))), PHRASE)
    # phrases that run over a text's end lie in no window of one text
    at = anchors(hashes, window - PHRASE + 1, _phrases_of(n_words))
    text = np.searchsorted(np.cumsum(n_words), at, side="right")
    place = at - (np.cumsum(n_words) - n_words)[text]
    whole = place + PHRASE <= n_words[text]
    return text[whole], place[whole], hashes[at[whole]].view(np.int64)


def _phrases_of(n_words: np.ndarray) -> np.ndarray:
    """Starts that each text has in the row of all words; a text's last ones, cut off by its end, are split off."""
    tails = np.minimum(n_words, PHRASE - 1)
    return np.stack([n_words - tails, tails], axis=1).ravel()


def _window_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window, of 64 and 32 bits, from the same hashes of its words."""
    hashes = word_hashes(b" ".join(words))
    second = run_hashes(hashes, window, 1) >> np.uint64(32)
    return run_hashes(hashes, window).view(np.int64), second.astype(np.uint32).view(np.int32)


def _count(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct rows of parallel key columns and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [*(k[at] for k in keys), np.diff(np.append(at, len(order)))]


def _phrase_counts(docs: DataFrame, window: int) -> DataFrame:
    """``(chunk, phrase, n)`` of every batch's phrases."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 8 * GROUP_BYTES):
            chunks, texts = batch.column(0).to_numpy(), as_bytes(batch.column(1))
            for i, j in byte_groups(texts, GROUP_BYTES):
                of, _, hashes = _phrase_anchors([(t or b"").split() for t in texts[i:j]], window)
                chunk, phrase, n = _count([chunks[i:j][of], hashes])
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(phrase), pa.array(n, pa.int64())], ["chunk", "phrase", "n"])

    return docs.select("chunk", "text").mapInArrow(scan, "chunk int, phrase long, n long")


def _recurring(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``counts`` whose keys occur at least twice in all, with the least chunk that has them as ``first``.

    A chunk's counts are few rows for a key, and a key's rows are sorted and
    spilled, not held; so one shuffle serves the sums and their join.
    """
    same = Window.partitionBy(*keys)
    told = counts.select("chunk", *keys, F.sum("n").over(same).alias("total"), F.min("chunk").over(same).alias("first"))
    return told.where("total > 1").drop("total")


def _place(h: np.ndarray, g: np.ndarray, known_h: np.ndarray, known_g: np.ndarray) -> np.ndarray:
    """Where the pairs (h, g) are among the known ones, sorted by both; -1 if they are not."""
    lo, hi = np.searchsorted(known_h, h, "left"), np.searchsorted(known_h, h, "right")
    at = np.full(len(h), -1)
    found = hi > lo
    at[found] = np.where(known_g[lo[found]] == g[found], lo[found], -1)
    for i in np.flatnonzero(hi - lo > 1).tolist():
        same = np.flatnonzero(known_g[lo[i]:hi[i]] == g[i])
        at[i] = lo[i] + same[0] if len(same) else -1
    return at


def _near_phrases(split: list[list[bytes]], recurring: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """Per text the starts of the windows whose least phrase recurs: a window that recurs is among them."""
    hashes = run_hashes(word_hashes(b" ".join(chain.from_iterable(split))), PHRASE)
    span = window - PHRASE + 1
    least = sliding(hashes, span, np.minimum) if len(hashes) >= span else hashes[:0]
    known = np.isin(least.view(np.int64), recurring)
    at = 0
    for words in split:
        yield np.flatnonzero(known[at:at + max(len(words) - window + 1, 0)])
        at += len(words)


def _stretches(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of the runs of consecutive numbers."""
    if len(at):
        edges = np.flatnonzero(np.diff(at) != 1)
        yield from zip(at[np.append(0, edges + 1)].tolist(), at[np.append(edges, -1)].tolist())


class PassageAutomaton:
    """Phrases of confirmed passages at every place that a window of a passage cannot avoid.

    A word of the passages is a character of its own, so that a phrase is a
    string of ``PHRASE`` characters and texts are compared word by word.
    """

    def __init__(self, passages: list[list[bytes]], window: int):
        self.window, self.automaton = window, ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.letters: dict[bytes, str] = {}
        self.passages = ["".join(self._letter(w) for w in p) for p in passages]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.passages):
            for k in range(0, len(p) - PHRASE + 1, window - PHRASE + 1):
                where.setdefault(p[k:k + PHRASE], []).append((n, k))
        for phrase, places in where.items():
            self.automaton.add_word(phrase, places)
        if where:
            self.automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        known = self.letters.get(word)
        if known is None:
            code = len(self.letters) + 2
            known = self.letters[word] = chr(code if code < 0xD800 else code + 0x800)  # no surrogates
        return known

    def found(self, words: list[bytes]) -> np.ndarray:
        """Which words lie in a stretch of a window or more that a passage has too."""
        gone = np.zeros(len(words), dtype=bool)
        if not len(self.automaton) or len(words) < self.window:
            return gone
        text = "".join([self.letters.get(w, "\x01") for w in words])
        done: dict[tuple[int, int], int] = {}  # how far a passage, laid against the text at a shift, was compared
        for end, places in self.automaton.iter(text):
            at = end - PHRASE + 1
            for n, k in places:
                if done.get((n, at - k), -1) > at:
                    continue
                passage = self.passages[n]
                back = _common(text[max(0, at - k):at][::-1], passage[max(0, k - at):k][::-1])
                to = at + PHRASE + _common(text[at + PHRASE:at + len(passage) - k], passage[k + PHRASE:])
                done[n, at - k] = to
                if to - at + back >= self.window:
                    gone[at - back:to] = True
        return gone


def _common(a: str, b: str) -> int:
    """How many characters two strings begin with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _automata(passages: list[list[bytes]], window: int) -> list[PassageAutomaton]:
    """The shards of the passages: each of at most ``SHARD_WORDS`` words, so that every word has its character."""
    parts, size = [[]], 0
    for p in passages:
        if parts[-1] and size + len(p) > SHARD_WORDS:
            parts.append([])
            size = 0
        parts[-1].append(p)
        size += len(p)
    return [PassageAutomaton(part, window) for part in parts]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _cut(text: bytes, words: list[bytes], removed: np.ndarray) -> bytes:
    """The text without the removed words; what is kept stays as it is, stretches joined by one space."""
    out, at, begin, end = [], 0, None, 0
    for word, gone in zip(words, removed.tolist()):
        start = text.index(word, at)
        at = start + len(word)
        if gone:
            if begin is not None:
                out.append(text[begin:end])
            begin = None
        else:
            begin, end = (start if begin is None else begin), at
    return b" ".join(out + ([text[begin:end]] if begin is not None else []))


def chunk_column(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[Column, int]:
    """A chunk number per row, the same for rows equal in id and text, and the number of chunks that the table's bytes ask for."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    return F.pmod(F.xxhash64(F.lit("chunk"), F.col(id_col), F.col(text_col)), F.lit(chunks)).cast("int"), chunks


def spread(rows: DataFrame, recurring: DataFrame, chunks: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with the rows of chunks that equal rows made too large dealt over other chunks, with their phrases to each."""
    loads = rows.groupBy("chunk").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"))
    parts = F.least(F.ceil(F.col("bytes") / chunk_bytes), F.col("rows")).cast("int")
    large = stored(loads.where((F.col("bytes") > 4 * chunk_bytes) & (F.col("rows") > 1)).select("chunk", parts.alias("parts")), "large")
    if large.isEmpty():
        return rows, recurring
    large = bounded_broadcast(large)
    moved = F.pmod(F.xxhash64(F.lit("part"), "chunk", "part"), F.lit(chunks)).cast("int")
    chunk = F.when(F.coalesce("part", F.lit(0)) == 0, F.col("chunk")).otherwise(moved)
    dealt = rows.withColumn("number", F.monotonically_increasing_id()).join(large, "chunk", "left")
    dealt = dealt.withColumn("part", F.pmod("number", "parts").cast("int")).withColumn("chunk", chunk).select(rows.columns)
    told = recurring.join(large, "chunk", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return dealt, told.withColumn("chunk", chunk).select(recurring.columns)


def remove_repeated_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                            keep: list[str] | None = None, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(keep or id .., n_words, n_removed, kept_sha256[, kept_text])`` per row.

    A word goes if it lies in a window of ``window`` words whose sequence
    also starts anywhere else in the input, the same row included.  The
    digest is of the kept words joined by one space.  ``kept_text`` is the
    input text where nothing goes; else its kept stretches, inner white space
    unchanged, joined by one space.  A null or empty text has no words (and a
    null stays null); texts shorter than a window keep all; repeated rows
    count as other places, so both lose what they share; null ids and empty
    tables are fine; columns not in ``keep`` are not read.
    """
    if window < PHRASE:
        raise ValueError(f"a window has at least {PHRASE} words")
    kept = keep or [id_col]
    names = [f"c{k}" for k in range(len(kept))]
    arrow = [to_arrow_type(docs.schema[c].dataType) for c in kept]
    chunk, chunks = chunk_column(docs, id_col, text_col, chunk_bytes)
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names)], chunk.alias("chunk"), F.col(text_col).alias("text"))
    recurring = _recurring(_phrase_counts(rows, window), ["phrase"]).select("chunk", "phrase")
    rows, recurring = spread(rows, recurring, chunks, chunk_bytes)

    def locate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return located.empty_table()
        texts = as_bytes(left.column("text").combine_chunks())
        split = [(t or b"").split() for t in texts]
        runs, n_words, digests = [], [], []
        for words, starts in zip(split, _near_phrases(split, right.column("phrase").to_numpy(), window)):
            n_words.append(len(words))
            digests.append(None if len(starts) else _digest(words))
            runs.append([x for first, last in _stretches(starts) for x in (first, last + 1)])
        del split
        give_back()
        text = pa.array([t if with_text or r else None for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())
        return pa.Table.from_arrays([*(left.column(n) for n in names), left.column("chunk"), pa.array(n_words, pa.int64()),
                                     pa.array(digests, pa.string()), pa.array(runs, pa.list_(pa.int32())), text], schema=located)

    located = pa.schema([*zip(names, arrow), ("chunk", pa.int32()), ("n_words", pa.int64()),
                         ("sha", pa.string()), ("runs", pa.list_(pa.int32())), ("text", pa.string())])
    fields = dict(zip(names, kept))
    found = stored(rows.groupBy("chunk").cogroup(recurring.groupBy("chunk")).applyInArrow(
        locate, result_schema(docs, fields, "chunk int, n_words long, sha string, runs array<int>, text string")), "located")
    touched = found.where(F.size("runs") > 0)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 6 * GROUP_BYTES):
            chunks, runs, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
            for i, j in byte_groups(texts, 6 * GROUP_BYTES):
                parts = []
                for k in range(i, j):
                    one, two = _window_hashes(texts[k].split(), window)
                    at = _expand(runs[k])
                    parts.append((np.full(len(at), chunks[k]), one[at], two[at]))
                chunk, h, g, n = _count([np.concatenate(p) for p in zip(*parts)])
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(h), pa.array(g), pa.array(n, pa.int32())],
                                                 ["chunk", "h", "g", "n"])

    counts = touched.select("chunk", "runs", "text").mapInArrow(hashes, "chunk int, h long, g int, n int")
    confirmed = stored(_recurring(counts, ["h", "g"]), "confirmed")

    def cut_out(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return cut.empty_table()
        h, g = right.column("h").to_numpy(), right.column("g").to_numpy()
        order = np.lexsort((g, h))
        h, g, given = h[order], g[order], np.zeros(len(order), dtype=bool)
        chunk, texts, hashed_as = key[0].as_py(), [], []
        for text, runs in zip(as_bytes(left.column("text").combine_chunks()), left.column("runs").to_pylist()):
            words, at = text.split(), _expand(runs)
            one, two = _window_hashes(words, window)
            place = _place(one[at], two[at], h, g)
            fresh = np.zeros(len(at), dtype=bool)
            fresh[np.unique(place, return_index=True)[1]] = True  # of equal windows of this text the first
            fresh &= (place >= 0) & ~given[place]
            given[place[fresh]] = True
            for first, last in _stretches(at[fresh]):
                for a in range(first, last + 1, PIECE_WINDOWS):
                    b = min(last, a + PIECE_WINDOWS - 1)
                    texts.append(b" ".join(words[a:b + window]))
                    hashed_as.append(one[a:b + 1])
        give_back()
        return pa.Table.from_arrays([pa.array((chunk << 32) + np.arange(len(texts)), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()),
                                     pa.array(hashed_as, pa.list_(pa.int64()))], schema=cut)

    cut = pa.schema([("passage", pa.int64()), ("words", pa.string()), ("h", pa.list_(pa.int64()))])
    own = confirmed.where("chunk = first").select("chunk", "h", "g")
    passages = stored(touched.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(cut_out, "passage long, words string, h array<long>"), "passages")
    asked = confirmed.select("chunk", "h").join(passages.select("passage", F.explode("h").alias("h")), "h").select("chunk", "passage").distinct()
    shards = asked.join(passages.select("passage", "words"), "passage").select("chunk", "words")

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return removed.empty_table()
        automata = _automata([p.split() for p in as_bytes(right.column("words").combine_chunks())], window)
        n_removed, digests, texts = [], [], []
        for text in as_bytes(left.column("text").combine_chunks()):
            words = text.split()
            gone = np.logical_or.reduce([a.found(words) for a in automata])
            n_removed.append(int(gone.sum()))
            digests.append(_digest([w for w, x in zip(words, gone.tolist()) if not x]))
            texts.append((_cut(text, words, gone) if gone.any() else text) if with_text else None)
        give_back()
        return pa.Table.from_arrays([*(left.column(n) for n in names), left.column("n_words"), pa.array(n_removed, pa.int64()),
                                     pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], schema=removed)

    removed = pa.schema([*zip(names, arrow), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                         ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    changed = touched.groupBy("chunk").cogroup(shards.groupBy("chunk")).applyInArrow(
        remove, result_schema(docs, fields, "n_words long, n_removed long, kept_sha256 string, kept_text string"))
    untouched = found.where(F.size("runs") == 0).select(*names, "n_words", F.lit(0).cast("long").alias("n_removed"),
                                                        F.col("sha").alias("kept_sha256"), F.col("text").alias("kept_text"))
    out = untouched.unionByName(changed)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)


def _expand(runs: list[int]) -> np.ndarray:
    return np.concatenate([np.arange(a, b) for a, b in zip(runs[::2], runs[1::2])])


ORACLE_OP6 = r"""
with dw as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') as w
            from documents),
win as (select r, i, hash(array_to_string(w[i:i + 34], ' ')) as h, md5_number(array_to_string(w[i:i + 34], ' ')) as g
        from (select r, w, unnest(range(1, len(w) - 33)) as i from dw where len(w) >= 35)),
again as (select h, g from win group by h, g having count(*) > 1),
gone as materialized (select distinct r, unnest(range(i, i + 35)) as p from win join again using (h, g)),
words as (select r, doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from dw),
kept as (select r, string_agg(word, ' ' order by p) as text from words anti join gone using (r, p) group by r),
n as (select r, count(*) as n_removed from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from dw left join kept using (r) left join n using (r)
"""
