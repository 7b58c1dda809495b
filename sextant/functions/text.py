"""Text column expressions (all JVM-side, no Python UDFs).

Every function takes and returns a ``Column`` so it composes inside
``select``/``withColumn`` and stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
# Prompt templates, with %s placeholders in this order: utterance(s), candidates.
EXTRACTION_PROMPT = "Given the following utterance: %s. The intent was to"
LABEL_PROMPT = ("Given these utterances: %s. What is the best fitting intent, "
                "if any, among the following: %s")
# Word budget of one label prompt, and the words of the template without its
# two placeholders (16 whitespace tokens minus the two that hold %s).
PROMPT_WORD_BUDGET = 512
LABEL_PROMPT_FIXED_WORDS = 14
LABEL_PROMPT_EMPTY_WORDS = 16
# Datasets whose true intents are not Pascal case.
PLAIN_CASE_DATASETS = ["atis", "banking77", "bitext", "clinc", "personal_assistant",
                       "stack_overflow", "twacs"]

# White space as ``str.split`` and ``str.strip`` know it: Unicode's, and four control characters.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
# Unicode-aware replacement for Python's ``[^\w\s]`` (Java's \w is ASCII only).
_NON_WORD = r"[^\p{L}\p{N}_\p{IsWhite_Space}\x1c-\x1f]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading and trailing whitespace, like ``str.strip``."""
    return F.regexp_replace(_col(c), rf"^{SPACE}+|{SPACE}+\z", "")


def normalize_text(c) -> Column:
    """Punctuation to space, lower, split on single spaces, strip, drop empties, join."""
    lowered = F.lower(F.regexp_replace(_col(c), _NON_WORD, " "))
    parts = F.transform(F.split(lowered, " "), strip_ws)
    return F.array_join(F.filter(parts, lambda t: t != ""), " ")


def words(c) -> Column:
    """Whitespace tokens, like ``str.split()`` with no argument."""
    return F.filter(F.split(_col(c), f"{SPACE}+"), lambda w: w != "")


def word_count(c) -> Column:
    """``len(s.split())``."""
    return F.size(words(c))


def clean_generated(c) -> Column:
    """Missing -> '', '_' and '-' -> space, lower case."""
    return F.lower(F.translate(F.coalesce(_col(c), F.lit("")), "_-", "  "))


def pascal_split(c) -> Column:
    """``' '.join(re.findall('[A-Z][^A-Z]*', x))``: text before the first capital is dropped."""
    return F.array_join(F.regexp_extract_all(_col(c), F.lit("[A-Z][^A-Z]*"), 0), " ")


def clean_intent(c, pascal_case=True) -> Column:
    """Optional Pascal split, then '_'/'-' to space, lower case.

    ``pascal_case`` may be a Python bool or a boolean Column (per-row dataset flag).
    """
    x = _col(c)
    if isinstance(pascal_case, bool):
        split = pascal_split(x) if pascal_case else x
    else:
        split = F.when(pascal_case, pascal_split(x)).otherwise(x)
    return F.lower(F.translate(split, "_-", "  "))


def is_pascal_dataset(dataset_col) -> Column:
    """True unless the dataset is one of the plain-case datasets."""
    return ~_col(dataset_col).isin(PLAIN_CASE_DATASETS)


def render_extraction_prompt(c) -> Column:
    """T5: ``template % text``."""
    return F.format_string(EXTRACTION_PROMPT, _col(c))


def render_label_prompt(utterances, candidates) -> Column:
    """``template % (utterances, candidates)``."""
    return F.format_string(LABEL_PROMPT, _col(utterances), _col(candidates))


def pair_text(action, obj) -> Column:
    """``"{}-{}".format(action, object)``."""
    return F.concat_ws("-", _col(action), _col(obj))


def strip_suffix(c, suffix: str = ".csv") -> Column:
    """``name.replace('.csv', '')``."""
    return F.replace(_col(c), F.lit(suffix), F.lit(""))


def strip_answer(c) -> Column:
    """``answer.strip()``."""
    return strip_ws(c)


def hash_words(c) -> Column:
    """Lower-case word tokens for hashing: runs of letters, digits and '_'."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
