"""Numbers of tokens of whole texts: byte-pair merging over a heap and a linked list, with no identifiers emitted.

The library's own normaliser and pre-tokenizer cut a text into pre-tokens. The symbols of a pre-token form a linked list, and
a heap holds its adjacent pairs by rank and place: the lowest is merged, the two pairs that arise beside it are pushed, and pairs
whose symbols have changed since are passed over. A pre-token has as many tokens as symbols at first, less one per merge.

Pre-tokens of byte-level BPE never run across a blank that something other than white space follows, so a text's count is the
sum of those of its pieces between such blanks. Pieces repeat: each is merged once per slice of text, or taken from a
bounded cache of the worker.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runline.llm.tokens import IRREGULAR, text_batches

#: Pre-tokens whose counts each half of a worker's cache keeps, and the longest one kept (characters).
CACHED, CACHED_LENGTH = 1 << 19, 64


def _class(kind: str) -> str:
    """Characters of a general category below U+0250, where it is the same in every version of Unicode, as a class of a pattern."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


_SPACE, _LETTER, _NUMBER = r"\t-\r\x20\x85\xa0", _class("L"), _class("N")
#: Pieces without characters beyond it are cut into pre-tokens here, others by the library.
_BEYOND = re.compile(r"[^\x00-\u024f]")
_PRE_TOKENS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?[{_LETTER}]+|\x20?[{_NUMBER}]+|\x20?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


class Merges:
    """A byte-level BPE model of the library `tokenizers`, read from its file `<name>.json`."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(f"{name}.json")
        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, added = told["model"], told["added_tokens"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError(f"{name}: not a plain BPE model")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{name}: added tokens that take more than their own string")
        ids = model["vocab"]
        self.symbol, self.suffix = ids, model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # A pair of symbols is one number, and so is an entry of the heap: its rank, then its place.
        self.rank = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.whole_of = [ids[a + b] for a, b in pairs]
        # Byte-level models write a byte as one character: itself, if it can be seen, or one from U+0100 on.
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        unseen = [b for b in range(256) if b not in seen]
        self.byte = [ids[chr(b) if b in seen else chr(256 + unseen.index(b))] for b in range(256)]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.normalise = library.normalizer.normalize_str if library.normalizer else None
        self.pre_tokens = library.pre_tokenizer.pre_tokenize_str
        # Only of this pre-tokenizer it is known where a text can be cut.
        self.by_blanks = told["normalizer"] is None and told["pre_tokenizer"]["type"] == "ByteLevel" and told["pre_tokenizer"]["use_regex"] and not told["pre_tokenizer"]["add_prefix_space"]
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged(self, at: list[int]) -> int:
        """Tokens of one pre-token, given as symbols; the list is used up."""
        n, rank_of, whole_of, pop, push = len(at), self.rank.get, self.whole_of, heapq.heappop, heapq.heappush
        ranks = [rank_of(a << 32 | b) for a, b in zip(at, at[1:])]  # noqa: B905
        heap = [rank << 32 | i for i, rank in enumerate(ranks) if rank is not None]
        heapq.heapify(heap)
        after, before, count = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            lowest = pop(heap)
            rank, i = lowest >> 32, lowest & 0xFFFFFFFF
            j = after[i]
            if j == n or at[i] < 0 or rank_of(at[i] << 32 | at[j]) != rank:
                continue
            whole = at[i] = whole_of[rank]
            at[j] = -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(whole << 32 | at[k])
                if rank is not None:
                    push(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(at[h] << 32 | whole)
                if rank is not None:
                    push(heap, rank << 32 | h)
        return count

    def known(self, pre_token: str) -> int:
        """Tokens of a pre-token of a byte-level model, from the cache of those met lately: its older half goes when it is full."""
        count = self.young.get(pre_token)
        if count is None:
            count = self.old.get(pre_token)
            if count is None:
                count = self.merged([self.byte[b] for b in pre_token.encode()])
            if len(pre_token) <= CACHED_LENGTH:
                if len(self.young) >= CACHED:
                    self.old, self.young = self.young, {}
                self.young[pre_token] = count
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text without strings of added tokens."""
        if not text:
            return 0
        if self.by_blanks:
            return sum(map(self.known, self.cut(text)))
        text = self.normalise(text) if self.normalise else text
        count = 0
        for pre_token, _ in self.pre_tokens(text):
            parts = list(pre_token)
            parts[-1] += self.suffix
            count += self.merged([self.symbol[p] for p in parts])
        return count

    def cut(self, text: str) -> list[str]:
        """Pre-tokens, as they stand in the text."""
        if _BEYOND.search(text):
            return [text[a:b] for _, (a, b) in self.pre_tokens(text)]
        return _PRE_TOKENS.findall(text)

    def whole(self, text: str) -> int:
        """Tokens of any text: the string of an added token is one, wherever it stands."""
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def pieces(self, texts: list[str]) -> np.ndarray:
        """Tokens of each piece, a blank before it: those of few characters are cut into pre-tokens as one text, as a blank begins each
        and stands nowhere else."""
        out, plain = np.zeros(len(texts), np.int64), np.ones(len(texts), dtype=bool)
        for i, t in enumerate(texts):
            if not t.isascii() and _BEYOND.search(t):
                out[i], plain[i] = self.plain(" " + t), False
        if plain.any():
            pre_tokens = _PRE_TOKENS.findall(" " + " ".join(t for t, p in zip(texts, plain.tolist(), strict=True) if p))
            counts = np.fromiter(map(self.known, pre_tokens), np.int64, len(pre_tokens))
            begins = np.fromiter((p[0] == " " for p in pre_tokens), bool, len(pre_tokens))
            out[plain] = np.add.reduceat(counts, np.flatnonzero(begins))
        return out

    def batch(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; nulls are empty."""
        n = len(texts)
        texts = texts.fill_null("")
        if not self.by_blanks or not n:
            return np.array([self.whole(t) for t in texts.to_pylist()], dtype=np.int64)
        alone = pc.match_substring_regex(texts, IRREGULAR)
        if self.special is not None:
            alone = pc.or_(alone, pc.match_substring_regex(texts, self.special.pattern))
        split = pc.split_pattern(pc.if_else(alone, pa.scalar("", texts.type), texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        piece, spelled = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        first = np.zeros(len(piece), dtype=bool)
        first[offsets[:-1]] = True  # even an empty text has one piece
        later, table = np.flatnonzero(np.bincount(piece[~first], minlength=len(spelled))), np.zeros(len(spelled), dtype=np.int64)
        table[later] = self.pieces([spelled[k] for k in later.tolist()])
        counts = table[piece]
        heads, at = np.unique(piece[first], return_inverse=True)
        counts[first] = np.array([self.plain(spelled[k]) for k in heads.tolist()], dtype=np.int64)[at]
        out = np.add.reduceat(counts, offsets[:-1])
        whole = np.flatnonzero(alone.to_numpy(zero_copy_only=False))
        out[whole] = [self.whole(t) for t in texts.take(pa.array(whole)).to_pylist()]
        return out


@functools.cache
def merges_of(name: str = "byte_bpe_50k") -> Merges:
    """One model per worker process."""
    return Merges(name)


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", limit: int = 1024) -> DataFrame:
    """A row per row of `docs`: `id`, `n_bytes` (UTF-8), `n_tokens`, `over_limit` (more than `limit` tokens). Nothing is shuffled.

    Texts count whole, whatever their length, with no special tokens added; the string of one inside a text is one token, as the
    library has it. A null or empty text has 0 of both; rows are counted one by one, so repeated rows and ids of any type, null ones
    too, are no case of their own; an empty table gives no rows; other columns are not read. `vocabulary` names a BPE file
    of `public_tokenizers`; one whose model has further rules is refused with a ValueError, and so is an id column named like a count.
    """
    if id in ("n_bytes", "n_tokens", "over_limit"):
        raise ValueError(f"the id column has the name of a count: {id}")

    def run(batches):
        model = merges_of(vocabulary)
        for batch in batches:
            for own in text_batches(batch, "text"):
                texts = own.column(1)
                size = pc.binary_length(texts).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(0), size, pa.array(model.batch(texts))], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id].dataType.simpleString()
    counts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counts.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
