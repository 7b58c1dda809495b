"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations.

The windows of the benchmark items are phrases to look up.  The corpus count
of every benchmark word orders each phrase's terms; postings (term, document,
position and the words around it) are stored for the two rarest terms of each
phrase only.  Offset-adjusted lists of these two are intersected, and what is
left is compared word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import stored
from sextant.session import bounded_broadcast

#: Fixed value: what separates words, after lower-casing A to Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a benchmark-sized table that may be broadcast; larger ones are shuffled.
BROADCAST_TERMS = 100_000


def words_of(text: Column) -> Column:
    """The words of a whole text; none for a null one."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(lowered, SEPARATORS, -1), lambda w: w != "")


def benchmark_windows(items: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """``(item, phrase)``: the distinct windows of ``n`` words of each item, or all words of a shorter one."""
    words = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    phrases = F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i + 1, n)))
    return words.select("item", F.explode(phrases).alias("phrase")).distinct()


def rarest_terms(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """``(phrase, size, t1, o1, t2, o2)``: two rarest terms of each phrase in the corpus, with their offsets.

    Phrases with a term that the corpus never uses are gone.  A phrase of one
    word has the same term twice.
    """
    terms = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("o", "term"))
    vocabulary = bounded_broadcast(terms.select("term").distinct(), BROADCAST_TERMS)
    counts = (docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(vocabulary, "term")
              .groupBy("term").count())
    known = (terms.join(counts, "term", "left").groupBy("phrase")  # a phrase has a fixed number of terms
             .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "o", "term"))).alias("t")))
    second = F.least(F.lit(2), F.size("t"))
    return known.where(F.col("t")[0]["n"] > 0).select(
        "phrase", F.size("t").alias("size"), F.col("t")[0]["term"].alias("t1"), F.col("t")[0]["o"].alias("o1"),
        F.element_at("t", second)["term"].alias("t2"), F.element_at("t", second)["o"].alias("o2"))


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """``(term, k1, k2, pos, around)`` for every place of the terms; ``around``: ``reach`` words to either side."""
    words = docs.select("k1", "k2", words_of(F.col("text")).alias("w"))
    places = words.select("k1", "k2", "w", F.posexplode("w").alias("pos", "term")).join(terms, "term")
    first = F.greatest(F.lit(0), F.col("pos") - reach)
    around = F.slice("w", first + 1, F.col("pos") - first + 1 + reach)
    return places.select("term", "k1", "k2", "pos", around.alias("around"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, k1, k2, text)``: rows with the same id and text have the same two 64-bit keys."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("k1"),
                       F.xxhash64(F.col(text_col), F.col(id_col)).alias("k2"), F.col(text_col).alias("text"))


def phrase_hits(docs: DataFrame, phrases: DataFrame, n: int) -> DataFrame:
    """``(k1, k2, start, size, phrase)``: every exact occurrence of the phrases in the keyed documents."""
    lookup = stored(rarest_terms(phrases, docs), "phrases")
    terms = lookup.select(F.col("t1").alias("term")).union(lookup.select("t2")).distinct()
    index = stored(postings(docs, bounded_broadcast(terms, BROADCAST_TERMS), n - 1), "postings")
    first = (index.withColumnRenamed("term", "t1").join(bounded_broadcast(lookup, BROADCAST_TERMS), "t1")
             .withColumn("start", F.col("pos") - F.col("o1")).where("start >= 0"))
    other = index.select(F.col("term").alias("t2"), "k1", "k2", F.col("pos").alias("p2"))
    both = first.withColumn("p2", F.col("start") + F.col("o2")).join(other.distinct(), ["t2", "k1", "k2", "p2"], "left_semi")
    before = F.least(F.col("pos"), F.lit(n - 1))  # words in `around` before the term
    same = F.concat_ws(" ", F.slice("around", before - F.col("o1") + 1, F.col("size"))) == F.col("phrase")
    return both.where(same).select("k1", "k2", "start", "size", "phrase").distinct()


def near_hits(docs: DataFrame, phrases: DataFrame, slop: int, n: int) -> DataFrame:
    """``(k1, k2, phrase)`` of keyed documents that hold a phrase loosely: around a place of its rarest term, every
    term of the phrase stands at most ``slop`` words off its place.

    Postings are stored for the phrases' rarest terms, each with the words around it, and all terms' lists are
    intersected there.  Exact occurrences are among the matches.
    """
    lookup = rarest_terms(phrases, docs).withColumn("terms", F.split("phrase", " "))
    lookup = stored(lookup.select("phrase", "size", "t1", "o1", "terms"), "phrases")
    reach = n - 1 + slop
    index = postings(docs, bounded_broadcast(lookup.select(F.col("t1").alias("term")).distinct(), BROADCAST_TERMS), reach)
    found = index.withColumnRenamed("term", "t1").join(bounded_broadcast(lookup, BROADCAST_TERMS), "t1")
    start = F.least(F.col("pos"), F.lit(reach)) - F.col("o1")  # the phrase's first place among the words around

    def stands(o: Column) -> Column:
        low = F.greatest(start + o - slop, F.lit(0))
        near = F.slice("around", low + 1, F.greatest(start + o + slop - low + 1, F.lit(0)))
        return F.array_contains(near, F.col("terms")[o])
    return found.where(F.forall(F.sequence(F.lit(0), F.col("size") - 1), stands)).select("k1", "k2", "phrase").distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, slop: int | None = None) -> DataFrame:
    """``(keep or id .., n_words, n_hit, n_items, items_sha256, contaminated[, n_near_items])`` per row.

    A word is hit if it lies in any occurrence of a window of any item.  A
    null or empty text has no words and no hits; items without words have no
    windows; equal items each count.  Null ids and repeated rows get a result
    row each; empty documents or items give no rows or no hits; other columns
    are kept only if named; texts of any length count whole.  With a ``slop``,
    ``n_near_items`` counts the items with a window that the row holds
    loosely (:func:`near_hits`), exact occurrences included.  Items are the digest of the ids, as sorted
    strings, joined by commas; of the empty string where there are none.
    """
    rows = keyed(docs, id_col, text_col)
    windows = stored(benchmark_windows(items, n, item_col, item_text_col), "windows")
    hits = stored(phrase_hits(rows, windows.select("phrase").distinct(), n), "hits")
    spans = hits.select("k1", "k2", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    earlier = Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    n_hit = (spans.withColumn("new", F.greatest(F.col("end") - reached, F.lit(0)))
             .groupBy("k1", "k2").agg(F.sum("new").cast("long").alias("n_hit")))
    found = (hits.select("k1", "k2", "phrase").distinct().join(bounded_broadcast(windows, BROADCAST_TERMS), "phrase")
             .groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("i")))
    found = found.select("k1", "k2", F.size("i").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "i"), 256).alias("items_sha256"))
    kept = keep or [id_col]
    whole = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)], F.xxhash64(F.col(id_col)).alias("k1"),
                        F.xxhash64(F.col(text_col), F.col(id_col)).alias("k2"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    out = whole.join(n_hit.join(found, ["k1", "k2"]), ["k1", "k2"], "left")
    near = []
    if slop is not None:
        loose = near_hits(rows, windows.select("phrase").distinct(), slop, n).join(bounded_broadcast(windows, BROADCAST_TERMS), "phrase")
        out = out.join(loose.groupBy("k1", "k2").agg(F.countDistinct("item").alias("n_near_items")), ["k1", "k2"], "left")
        near = [F.coalesce("n_near_items", F.lit(0)).alias("n_near_items")]
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), *near)


ORACLE_OP9 = r"""
with dw as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
iw as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
win as materialized (select distinct item_id, array_to_string(w[i:i + 9], ' ') as phrase, least(len(w), 10) as size
        from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct size from win),
grams as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as phrase
          from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, sizes where len(w) >= size)),
hits as materialized (select distinct doc_id, i, size, item_id from grams join win using (phrase, size)),
hit_words as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
hit_items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
              from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit_words using (doc_id) left join hit_items using (doc_id)
"""
