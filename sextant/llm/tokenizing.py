"""Safe cutting of texts for public tokenizers, and bounded reuse of the encodings of the cuts.

A cut is safe where no token of the whole text can span it, so that the
encodings of the pieces, put together, are the encoding of the whole:

* sentencepiece BPE whose pieces hold the space mark only in front (or are
  runs of it): at a single space between two characters that are neither
  spaces nor the mark itself; the space then returns as the mark that each
  piece gets in front;
* byte-level BPE whose pattern puts at most one space before a word: before
  a space that follows a character other than white space.

Texts without a safe cut, and tokenizers of other kinds, are encoded whole.
Words repeat, so a worker keeps what it knows of parts, up to a fixed number.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

MARK = "▁"
_SINGLE_SPACE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
_SPACE_AFTER_SPACE = re.compile(r"\s ")
#: Characters whose classes are the same in every Unicode version that the libraries hold.
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: Fixed value: the word pattern of this kind of byte-level BPE.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts that a worker keeps at most.
MEMO_PARTS = 600_000


def cut_at_single_spaces(text: str) -> list[str]:
    parts = text.split(" ")
    return _SINGLE_SPACE.split(text) if MARK in text or "" in parts else parts


def _whole(text: str) -> list[str]:
    return [text]


class LengthEncoder:
    """Numbers of tokens of texts, encoded by batches of distinct parts."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            kept = model.decode(model.encode("a  b ")) == "a  b "  # spaces are neither merged nor trimmed
            safe = kept and not any(MARK in p[1:] and p.strip(MARK) for p in pieces)
            self.cut = cut_at_single_spaces if safe else _whole
            self.encode = lambda parts: model.encode(parts, num_threads=1)
        else:
            model = _tokenizer(path)
            self.cut = _whole
            self.encode = lambda parts: [e.ids for e in model.encode_batch_fast(parts, add_special_tokens=False)]
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        cuts = [self.cut(t) for t in texts]
        new = list(set(chain.from_iterable(cuts)).difference(self.known))
        if new:
            if len(self.known) + len(new) > MEMO_PARTS:
                self.known = {}
                new = list(set(chain.from_iterable(cuts)))
            self.known.update(zip(new, map(len, self.encode(new))))
        get = self.known.__getitem__
        return [sum(map(get, c)) for c in cuts]


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _same_ranks(kind: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens for the ranked form of a byte-level BPE file, if it has one.

    The file must be plain: this pattern, no added space, no normaliser, no
    special token that takes space with it, and ids in the order of merges.
    """
    pre, model, added = kind.get("pre_tokenizer") or {}, kind["model"], kind.get("added_tokens", [])
    plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
             and not kind.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
             and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added))
    if not plain:
        return None
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merges]
    if ids != sorted(ids) or ids[:1] != [256]:
        return None
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the others from 256 on
    shown = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(seen))}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return ranks, special


class IdEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    Plain byte-level BPE goes by parts: new parts are put together, encoded
    in one call, and told apart by their tokens' byte lengths.
    """

    def __init__(self, path: str):
        self.model = _tokenizer(path)
        with open(path, encoding="utf-8") as f:
            found = _same_ranks(json.load(f))
        self.fast = None
        if found:
            import tiktoken
            ranks, special = found
            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.widths = np.zeros(1 + max([*ranks.values(), *special.values()]), dtype=np.int64)
            for token, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
                self.widths[i] = len(token)
        self.known: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        """``known`` gets the ids of " " + part for each part, none of which ends in white space."""
        if _BEYOND_LATIN.search(" ".join(parts)):
            rare = {p for p in parts if _BEYOND_LATIN.search(p)}
            self.known.update((p, self._library(" " + p)) for p in rare)
            parts = [p for p in parts if p not in rare]
        if not parts:
            return
        together = " " + " ".join(parts)
        ids = np.asarray(self.fast.encode(together, allowed_special="all"), dtype="<u4")
        sizes = np.fromiter(map(len, together.encode().split(b" ")[1:]), dtype=np.int64, count=len(parts))
        ends = (np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(sizes + 1)) + 1) * 4
        blob, starts = ids.tobytes(), np.concatenate(([0], ends[:-1]))
        self.known.update((p, blob[i:j]) for p, i, j in zip(parts, starts.tolist(), ends.tolist()))

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [self._library(t) for t in texts]
        cuts = [None if not t or t[0] == " " or t[-1].isspace() or _SPACE_AFTER_SPACE.search(t) else t.split(" ") for t in texts]
        wanted = set(chain.from_iterable(c[1:] for c in cuts if c))
        new = wanted.difference(self.known)
        if new:
            if len(self.known) + len(new) > MEMO_PARTS:
                self.known, new = {}, wanted
            self._learn(list(new))
        get = self.known.__getitem__
        return [self._library(t) if c is None else self._library(c[0]) + b"".join(map(get, c[1:])) for t, c in zip(texts, cuts)]


@lru_cache(maxsize=4)
def length_encoder(path: str) -> LengthEncoder:
    """One per worker process and file."""
    return LengthEncoder(path)


@lru_cache(maxsize=4)
def id_encoder(path: str) -> IdEncoder:
    """One per worker process and file."""
    return IdEncoder(path)
