"""Token tables (D6, D7, J8) and a built-in rule annotator.

A token table row carries ``tokens ARRAY<STRUCT<i INT, text STRING, pos
STRING, dep STRING, head INT>>`` (``i`` is 0-based; a token without an arc
has ``dep = ''`` and ``head = i``).  Whoever produced the tokens (an
injected parser via :func:`annotate`, or :func:`rule_annotate`), the
candidate operators only read this column.

Everything is computed per document, by arrays or higher-order array
functions: no shuffle, and whole texts are processed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_SCHEMA = "array<struct<i:int,text:string,pos:string,dep:string,head:int>>"

# Fixed rule-annotator vocabulary (ours; not linguistically faithful).
MIN_TAG_LETTERS = 5
#: Suffixes of words whose A-Z are lower-cased; the Kelvin sign and O with acute are lower-cased to k and o with acute.
VERB_SUFFIXES = [b"ing", b"ed", b"er", b"ir", b"ar", b"en"]
NOUN_SUFFIXES = [s.encode() for s in ("tion", "ment", "s", "ung", "keit", "\u212aeit", "ción", "ciÓn", "heit")]
LINE_ENDS = [s.encode() for s in ("\u0085", "\u2028", "\u2029")]
NEGATIONS = ["no", "pas", "nicht"]
OBJECT_WINDOW = 5
COMPOUND_WINDOW = 2
NEGATION_WINDOW = 3
#: Of the 256 bytes: ends of sentences, ends of words, lower-cased A-Z.
SENTENCE_ENDS = np.isin(np.arange(256), list(b".!?\n"))
SPLITS = SENTENCE_ENDS | np.isin(np.arange(256), list(b" \t\x0b\f\r"))
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
POS_TAGS, DEPS = pa.array(["X", "VERB", "NOUN"]), pa.array(["", "dobj", "compound", "neg"])
#: Bytes of text that are annotated at a time.
SLICE_BYTES = 4 << 20


# ---- D6 predicates on token structs -------------------------------------------------

def is_pos_tag(tok: Column, pos: str) -> Column:
    return tok["pos"] == pos


def is_dep(tok: Column, dep: str) -> Column:
    return tok["dep"] == dep


def right_is_head_of_left(left: Column, right: Column) -> Column:
    return left["head"] == right["i"]


def left_is_dep_of_right(left: Column, right: Column, dep: str) -> Column:
    return is_dep(left, dep) & right_is_head_of_left(left, right)


def token_at(tokens: Column, i: Column) -> Column:
    """Token with index ``i`` (0-based), or null."""
    return F.try_element_at(tokens, (i + 1).cast("int"))


# ---- rule annotator -----------------------------------------------------------------------

def _ends_with(data: np.ndarray, start: np.ndarray, end: np.ndarray, suffix: bytes) -> np.ndarray:
    """Which words ``data[start:end]`` end with these bytes."""
    out = end - start >= len(suffix)
    for k, byte in enumerate(reversed(suffix), 1):
        some = np.flatnonzero(out)
        out[some] = data[end[some] - k] == byte
    return out


def _is_word(data: np.ndarray, start: np.ndarray, end: np.ndarray, word: bytes) -> np.ndarray:
    out = end - start == len(word)
    some = np.flatnonzero(out)
    out[some] = _ends_with(data, start[some], end[some], word)
    return out


def _tags(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Places in ``POS_TAGS`` of the words; ``data`` has A-Z lower-cased."""
    tag = np.zeros(len(start), dtype=np.int8)
    some = np.flatnonzero(letters >= MIN_TAG_LETTERS)
    first, last = start[some], end[some]
    cut = np.zeros(len(some), dtype=np.int64)
    for mark in LINE_ENDS:  # a suffix may stand before one last line end
        cut = np.where(_ends_with(data, first, last, mark), len(mark), cut)
    last = last - cut
    for code, suffixes in ((2, NOUN_SUFFIXES), (1, VERB_SUFFIXES)):  # VERB goes first
        for suffix in suffixes:
            tag[some[_ends_with(data, first, last, suffix)]] = code
    return tag


def _tokens_of(texts: pa.Array) -> pa.Array:
    """The token arrays of whole texts; null for null."""
    given = texts.is_valid().to_numpy(zero_copy_only=False)
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kept = data != ord(",")
    ends = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[ends]
    data = data[kept]
    inside = ~SPLITS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    begins[firsts] = inside[firsts]  # a word ends with its text
    start = np.flatnonzero(begins)
    n = len(start)
    lengths = np.add.reduceat(np.append(inside, False), start, dtype=np.int64) if n else np.zeros(0, dtype=np.int64)
    end = start + lengths
    doc = np.searchsorted(ends, start, side="right") - 1
    sentence = np.cumsum(SENTENCE_ENDS[data], dtype=np.int64)[start] + doc
    marks = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    low = LOWER[data]
    tag = _tags(low, start, end, marks[end] - marks[start])
    k = np.arange(n)
    verb = tag == 1
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(verb, k, -1))])[:n]
    has = (tag == 2) & (before >= 0) & (k - before <= OBJECT_WINDOW)
    has &= sentence[before] == sentence
    obj_head = np.where(has, before, n)  # n: no object
    comp_head = np.full(n, -1)
    for step in range(COMPOUND_WINDOW, 0, -1):  # the nearest object wins
        at = np.flatnonzero(obj_head[step:] < k[:max(n - step, 0)])
        comp_head[at] = at + step
    after = np.concatenate([np.minimum.accumulate(np.where(verb, k, n)[::-1])[::-1], [n]])[1:]
    neg = np.zeros(n, dtype=bool)
    for word in NEGATIONS:
        neg |= _is_word(low, start, end, word.encode())
    some = np.flatnonzero(neg & (after - k <= NEGATION_WINDOW) & (after < n))
    neg_head = np.full(n, -1)
    neg_head[some] = np.where(sentence[after[some]] == sentence[some], after[some], -1)
    dep = np.where(has, 1, np.where(comp_head >= 0, 2, np.where(neg_head >= 0, 3, 0)))
    head = np.where(has, before, np.where(comp_head >= 0, comp_head, np.where(neg_head >= 0, neg_head, k)))
    per_doc = np.searchsorted(start, ends)
    base = per_doc[doc]
    at = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.StringArray.from_buffers(n, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[inside]))
    tokens = pa.StructArray.from_arrays(
        [pa.array((k - base).astype(np.int32)), words, POS_TAGS.take(pa.array(tag)), DEPS.take(pa.array(dep)), pa.array((head - base).astype(np.int32))],
        names=["i", "text", "pos", "dep", "head"])
    return pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), tokens, mask=pa.array(~given))


def _text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about ``SLICE_BYTES``, of one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def rule_annotate(df: DataFrame, text_col: str = "text", out_col: str = "tokens", read_once: bool = False) -> DataFrame:
    """D7 with built-in rules: adds the token array column (narrow, no shuffle).

    Rules, on words of at least 5 letters: VERB by suffix ing/ed/er/ir/ar/en,
    otherwise NOUN by suffix tion/ment/s/ung/keit/ción/heit.  A NOUN with a VERB
    at most 5 words to its left in the sentence is the ``dobj`` of the nearest
    one; up to 2 words right before such a NOUN and after its VERB are its
    ``compound``; ``no``/``pas``/``nicht`` up to 3 words before a VERB are its
    ``neg``.  Sentences split on . ! ? and newline; words on whitespace; commas
    are stripped.  Not linguistically faithful: it only gives the extraction
    operators realistic token graphs at any scale.

    All words of an Arrow batch are looked at together, by arrays.  Called
    nondeterministic so that the optimiser evaluates it once: a filter inferred
    from a generator over the tokens would annotate every text a second time.
    ``read_once``: one Arrow function alone reads the tokens
    (:func:`~sextant.operators.candidates.action_object_ext` ``by_arrays``); it
    then runs in the same worker, and tokens are not sent to the JVM and back.
    """
    @F.arrow_udf(TOKEN_SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        found = [_tokens_of(part) for part in _text_slices(texts)]
        return pa.concat_arrays(found) if found else _tokens_of(texts)

    return df.withColumn(out_col, (run if read_once else run.asNondeterministic())(F.col(text_col)))


def annotate(df: DataFrame, parse: Callable[[str], list[dict]], text_col: str = "text",
             out_col: str = "tokens") -> DataFrame:
    """D7 with an injected parser: ``parse(text) -> [{i, text, pos, dep, head}, ...]``.

    Runs in Arrow batches through ``mapInPandas``; the parser is loaded once
    per Python worker by the caller's closure.
    """
    schema = f"{', '.join(f'`{c}` {t}' for c, t in _ddl(df))}, `{out_col}` {TOKEN_SCHEMA}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[out_col] = [parse(t) if t is not None else [] for t in pdf[text_col]]
            yield pdf

    return df.mapInPandas(run, schema)


def _ddl(df: DataFrame):
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def explode_tokens(df: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """Token table in long form ``(id, i, text, pos, dep, head)``."""
    return df.select(id_col, F.explode(tokens_col).alias("t")).select(id_col, "t.*")


def token_heads(df: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """Every token that has an arc, with its head token's text (array lookup, no join)."""
    arcs = F.filter(F.col(tokens_col), lambda t: t["dep"] != "")
    rows = df.select(id_col, F.explode(F.transform(arcs, lambda t: F.struct(
        t["i"].alias("i"), t["text"].alias("text"), t["pos"].alias("pos"), t["dep"].alias("dep"),
        t["head"].alias("head"), token_at(F.col(tokens_col), t["head"])["text"].alias("head_text"))))
        .alias("a"))
    return rows.select(id_col, "a.*")
