"""Candidate intent extraction over token arrays.

D1 is a per-row array expression (linear in the arcs of a text).  D3-D5
match objects with their modifiers and negations through equi-joins on
``(id, head)`` over small exploded subsets of the tokens, so the work stays
linear in the tokens however many objects a long text has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import render_extraction_prompt
from sextant.operators.tokens import rule_annotate, token_at
from sextant.session import cut_lineage

PLACEHOLDER = "NONE"
MODIFIER_DEPS = ["compound", "amod"]


def _dobjs(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t["dep"] == "dobj")


def object_phrase(tokens: Column, obj: Column) -> Column:
    """D4 for one object token as an array expression (for short token arrays).

    Compound/amod children left of the object, in reading order, then the
    object, '_'-joined.  :func:`explode_pairs` computes the same with joins.
    """
    mods = F.filter(tokens, lambda m: m["dep"].isin(MODIFIER_DEPS) & (m["head"] == obj["i"])
                    & (m["i"] < obj["i"]))
    return F.array_join(F.concat(F.transform(mods, lambda m: m["text"]), F.array(obj["text"])), "_")


def action_phrase(tokens: Column, obj: Column) -> Column:
    """D5 for one object token as an array expression (for short token arrays).

    The object's head, prefixed by every negation of it (later ones in front).
    A negation counts when its head is the verb, or when the verb is an
    ``xcomp`` child of the negation's head.
    """
    verb = token_at(tokens, obj["head"])
    negs = F.filter(tokens, lambda n: (n["dep"] == "neg") & (
        (n["head"] == verb["i"]) | ((verb["dep"] == "xcomp") & (verb["head"] == n["head"]))))
    return F.array_join(F.concat(F.reverse(F.transform(negs, lambda n: n["text"])),
                                 F.array(verb["text"])), "_")


def action_object(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Basic pair.  Per ``dobj`` arc (in order) the left word is the action if a VERB
    and the right word the object if a NOUN; the last match wins for each slot
    independently; defaults ``NONE``; both lower-cased.
    """
    tokens = F.col(tokens_col)
    arcs = _dobjs(tokens)
    starts = F.transform(arcs, lambda a: token_at(tokens, F.least(a["i"], a["head"])))
    ends = F.transform(arcs, lambda a: token_at(tokens, F.greatest(a["i"], a["head"])))
    action = F.try_element_at(F.filter(starts, lambda s: s["pos"] == "VERB"), F.lit(-1))["text"]
    obj = F.try_element_at(F.filter(ends, lambda e: e["pos"] == "NOUN"), F.lit(-1))["text"]
    return (df.withColumn("action", F.coalesce(F.lower(action), F.lit(PLACEHOLDER)))
              .withColumn("object", F.coalesce(F.lower(obj), F.lit(PLACEHOLDER)))
              .withColumn("candidate_intent", F.concat_ws("-", "action", "object")))


def _sorted_texts(name: str, desc: bool = False) -> Column:
    arr = F.sort_array(F.collect_list(F.struct("_i", "_text")), asc=not desc)
    return F.transform(arr, lambda s: s["_text"]).alias(name)


def _keys(id_col: str | list[str]) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def explode_pairs(df: DataFrame, id_col: str | list[str] = "id", tokens_col: str = "tokens") -> DataFrame:
    """D3-D5 in long form: ``(id, pair_no, token_i, action, object, pair)`` per ``dobj`` token.

    ``id_col`` may be a list of columns forming the row key (e.g. ``dataset, id``).

    One pass over the token arrays emits only the tokens that matter - objects
    (with their verb looked up in the array), modifiers and negations - as one
    small table, checkpointed so the annotation upstream runs once.  Objects
    are then matched with their modifiers and negations by equi-joins on
    ``(id, head)`` (J8), linear in the tokens however many objects a text has.
    """
    keys = _keys(id_col)
    tokens = F.col(tokens_col)
    nul_i, nul_s = F.lit(None).cast("int"), F.lit(None).cast("string")

    def item(kind, t, k=None, verb=None):
        return F.struct(F.lit(kind).alias("kind"), (k if k is not None else nul_i).alias("pair_no"),
                        t["i"].alias("_i"), t["text"].alias("_text"), t["head"].alias("_head"),
                        (verb["i"] if verb is not None else nul_i).alias("vi"),
                        (verb["text"] if verb is not None else nul_s).alias("vtext"),
                        (verb["dep"] if verb is not None else nul_s).alias("vdep"),
                        (verb["head"] if verb is not None else nul_i).alias("vhead"))

    items = df.select(*keys, F.explode(F.concat(
        F.transform(_dobjs(tokens), lambda o, k: item("o", o, k, token_at(tokens, o["head"]))),
        F.transform(F.filter(tokens, lambda t: t["dep"].isin(MODIFIER_DEPS)), lambda m: item("m", m)),
        F.transform(F.filter(tokens, lambda t: t["dep"] == "neg"), lambda n: item("n", n)))).alias("t")
    ).select(*keys, "t.*")
    items = cut_lineage(items)
    objs = items.where(F.col("kind") == "o").select(*keys, "pair_no", F.col("_i").alias("oi"),
                                                   F.col("_text").alias("otext"), "vi", "vtext", "vdep", "vhead")
    mods = items.where(F.col("kind") == "m").select(*keys, "_i", "_text", "_head")
    negs = items.where(F.col("kind") == "n").select(*keys, "_i", "_text", "_head")
    obj_mods = (objs.select(*keys, "oi", F.col("oi").alias("_head")).join(mods, keys + ["_head"])
                .where(F.col("_i") < F.col("oi"))
                .groupBy(*keys, "oi").agg(_sorted_texts("mods")))
    by_head = (objs.select(*keys, "oi", F.col("vi").alias("_head"))
               .join(negs, keys + ["_head"]).select(*keys, "oi", "_i", "_text"))
    by_xcomp = (objs.where(F.col("vdep") == "xcomp").select(*keys, "oi", F.col("vhead").alias("_head"))
                .join(negs, keys + ["_head"]).select(*keys, "oi", "_i", "_text"))
    obj_negs = (by_head.unionByName(by_xcomp).distinct()
                .groupBy(*keys, "oi").agg(_sorted_texts("negs", desc=True)))
    empty = F.array().cast("array<string>")
    out = (objs.join(obj_mods, keys + ["oi"], "left").join(obj_negs, keys + ["oi"], "left")
           .select(*keys, "pair_no", F.col("oi").alias("token_i"),
                   F.array_join(F.concat(F.coalesce("negs", empty), F.array("vtext")), "_").alias("action"),
                   F.array_join(F.concat(F.coalesce("mods", empty), F.array("otext")), "_").alias("object")))
    return out.withColumn("pair", F.concat_ws("-", "action", "object"))


def _first_pairs(tokens: pa.Array) -> pa.Array:
    """The first pair of each token array, by arrays; ``NONE`` where there is none."""
    if not len(tokens):
        return pa.array([], pa.string())
    ends = tokens.offsets.to_numpy().astype(np.int64)
    i, text, dep, head = (tokens.values.field(c) for c in ("i", "text", "dep", "head"))
    number, head = i.to_numpy(zero_copy_only=False), head.to_numpy(zero_copy_only=False)

    def of_kind(*kinds: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of these kinds, and whose they are; null arrays may hold some, which are not theirs."""
        at = np.flatnonzero(pc.fill_null(pc.is_in(dep, pa.array(kinds)), False).to_numpy(zero_copy_only=False))
        at = at[(at >= ends[0]) & (at < ends[-1])]
        return at, np.searchsorted(ends, at, side="right") - 1

    at, owner = of_kind("dobj")
    owners, first = np.unique(owner, return_index=True)
    valid = tokens.is_valid().to_numpy(zero_copy_only=False)[owners]
    owners, objects = owners[valid], at[first[valid]]
    verbs = ends[owners] + head[objects]
    xcomp = pc.fill_null(pc.equal(dep.take(pa.array(verbs)), "xcomp"), False).to_numpy(zero_copy_only=False)

    def beside(kinds: tuple[str, ...], wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, list]:
        at, owner = of_kind(*kinds)
        pair = np.minimum(np.searchsorted(owners, owner), max(len(owners) - 1, 0))
        known = owners[pair] == owner if len(owners) else np.zeros(len(at), dtype=bool)
        at, pair = at[known], pair[known]
        ok = wanted(at, pair)
        return pair[ok], text.take(pa.array(at[ok])).to_pylist()

    mods = beside(tuple(MODIFIER_DEPS), lambda m, p: (head[m] == number[objects[p]]) & (number[m] < number[objects[p]]))
    negs = beside(("neg",), lambda n, p: (head[n] == number[verbs[p]]) | (xcomp[p] & (head[verbs[p]] == head[n])))
    objects_text, verbs_text = ([[w] for w in text.take(pa.array(k)).to_pylist()] for k in (objects, verbs))
    for p, w in reversed([*zip(mods[0].tolist(), mods[1])]):
        objects_text[p].insert(0, w)
    for p, w in zip(negs[0].tolist(), negs[1]):
        verbs_text[p].insert(0, w)
    out = np.full(len(tokens), PLACEHOLDER, dtype=object)
    for k, verb, obj in zip(owners.tolist(), verbs_text, objects_text):
        out[k] = "_".join(verb) + "-" + "_".join(obj)
    return pa.array(out, pa.string())


def action_object_ext(df: DataFrame, tokens_col: str = "tokens", id_col: str | list[str] = "id", by_arrays: bool = False) -> DataFrame:
    """First pair of D3 with negations and modifiers, original case; none -> ``NONE``.

    ``by_arrays``: for tokens of ``rule_annotate(.., read_once=True)``, which no
    other column reads; an Arrow function in the worker that made them.

    Only a text's first object is looked at, so this is linear in its tokens
    and stays in the row.  The generator over one element keeps the optimiser
    from copying the tokens' own expression to each place that reads them.
    """
    if by_arrays:
        found = F.arrow_udf("string")(_first_pairs).asNondeterministic()  # so that no filter runs it a second time
        return df.withColumn("candidate_intent", found(F.col(tokens_col))).drop(tokens_col)
    held = df.withColumn("_tokens", F.explode(F.array(F.col(tokens_col))))
    tokens = F.col("_tokens")
    pairs = F.transform(F.slice(_dobjs(tokens), 1, 1),
                        lambda o: F.concat_ws("-", action_phrase(tokens, o), object_phrase(tokens, o)))
    first = F.coalesce(F.try_element_at(pairs, F.lit(1)), F.lit(PLACEHOLDER))
    return held.withColumn("candidate_intent", first).drop("_tokens")


def keep_candidates(df: DataFrame, col: str = "candidate_intent",
                    nulls_as_candidates: bool = False) -> DataFrame:
    """P5: drop candidates containing ``NONE`` (case-sensitive substring).

    The original treats a missing candidate as the text ``nan`` and keeps it;
    ``nulls_as_candidates=True`` restores that, the default drops nulls.
    """
    c = F.col(col)
    if nulls_as_candidates:
        return df.where(~F.coalesce(c, F.lit("nan")).contains(PLACEHOLDER))
    return df.where(c.isNotNull() & ~c.contains(PLACEHOLDER))


def prompt_candidates(df: DataFrame, generate: Callable, text_col: str = "text") -> DataFrame:
    """candidate = model answer to the extraction prompt of each utterance.

    Distinct prompts are answered once (a repeated utterance costs one call),
    through an Arrow-batched ``pandas_udf`` built from ``generate``.
    """
    from sextant.operators.inference import answer_prompts

    prompts = df.withColumn("prompt", render_extraction_prompt(F.col(text_col)))
    answers = answer_prompts(prompts.select("prompt").distinct(), generate, "prompt", "candidate_intent")
    return prompts.join(answers, "prompt", "left").drop("prompt")


METHODS = {"action-object": "action-object", "liu": "action-object",
           "action-object-ext": "action-object-ext", "mine": "action-object-ext",
           "t0pp-prompting": "prompting", "prompting": "prompting"}


def extract(df: DataFrame, method: str, text_col: str = "text", generate: Callable | None = None,
            tokens_col: str = "tokens", id_col: str | list[str] = "id") -> DataFrame:
    """Candidate extraction by method name (aliases of the notebooks accepted).

    ``id_col`` names the row key; pass ``["dataset", "id"]`` when several
    datasets (each numbering its rows from 0) are extracted together.
    """
    if method not in METHODS:
        raise ValueError(f"unsupported extraction method {method!r}")
    kind = METHODS[method]
    if kind == "prompting":
        if generate is None:
            raise ValueError("prompting extraction needs a generate function")
        return prompt_candidates(df, generate, text_col)
    if tokens_col not in df.columns:
        df = rule_annotate(df, text_col, tokens_col)
    if kind == "action-object":
        return action_object(df, tokens_col).drop(tokens_col)
    return action_object_ext(df, tokens_col, id_col).drop(tokens_col)
