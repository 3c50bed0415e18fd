"""Token ids of whole texts with a public byte-level BPE vocabulary, inside tasks.

Byte-level BPE cuts a text before every blank that a character other than white space follows, so a text's ids are the
ids of the pieces between such blanks, one after the other. Pieces repeat, so only the distinct pieces of a batch are
encoded. A text with a blank before other white space, or at its end, is encoded as a whole; one with a special
token's string by the tokenizer itself, which knows those.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text encoded at once; a longer text alone.
BATCH_BYTES = 8 << 20
#: Pieces whose ids are put in place at once: their places take eight times the bytes of the ids.
PIECES_AT_ONCE = 1 << 16
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
IRREGULAR = rf"\x20(?:[{_SPACE}]|\z)"


class Ids:
    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, number in ranks.items():
            self.bytes_of[number] = len(token)

    def one(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)

    def _joined(self, pieces: pa.Array) -> np.ndarray:
        """Ids of all pieces in a row, a blank before each."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py()
        return np.array(self.ranks.encode_ordinary(" " + text), dtype=np.int64)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, as unsigned 16-bit numbers; number of ids of each text). Nulls are empty."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        texts = texts.fill_null("")
        alone = pc.match_substring_regex(texts, IRREGULAR)
        for s in self.special:
            alone = pc.or_(alone, pc.match_substring(texts, s))
        split = pc.split_pattern(pc.if_else(alone, pa.scalar("", texts.type), texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        del split
        piece = coded.indices.to_numpy()
        first = offsets[:-1]  # even an empty text has one piece
        later = np.ones(len(piece), dtype=bool)
        later[first] = False
        # Pieces that a blank comes before: all distinct ones in one text, cut where they begin.
        used = np.flatnonzero(np.bincount(piece[later], minlength=len(coded.dictionary)))
        del later
        spelled = coded.dictionary.take(pa.array(used))
        sizes = pc.binary_length(spelled).to_numpy(zero_copy_only=False).astype(np.int64) + 1 if len(used) else np.zeros(0, np.int64)
        ids = self._joined(spelled) if len(used) else np.zeros(0, np.int64)
        begins = np.cumsum(self.bytes_of[ids]) - self.bytes_of[ids]
        cuts = np.append(np.searchsorted(begins, np.cumsum(sizes) - sizes), len(ids))
        # First pieces, and texts that are taken whole.
        heads = pc.if_else(alone, texts, coded.dictionary.take(pa.array(piece[first])))
        head_ids = [self.one(t) for t in heads.to_pylist()]
        head_sizes = np.array([len(x) for x in head_ids], dtype=np.int64)
        pool = np.concatenate((ids.astype(np.uint16), np.array([i for x in head_ids for i in x], dtype=np.uint16)))
        # Where each piece's ids begin in the pool, and how many they are.
        begin_of, size_of = np.zeros((2, len(coded.dictionary)), np.int32)
        begin_of[used], size_of[used] = cuts[:-1], np.diff(cuts)
        start, size = begin_of[piece], size_of[piece]
        start[first], size[first] = len(ids) + np.cumsum(head_sizes) - head_sizes, head_sizes
        del coded, piece, heads, head_ids
        ends = np.insert(np.cumsum(size, dtype=np.int64), 0, 0)
        out = np.empty(ends[-1], np.uint16)
        for low in range(0, len(size), PIECES_AT_ONCE):
            high = min(low + PIECES_AT_ONCE, len(size))
            at = np.repeat(start[low:high] - ends[low:high], size[low:high])
            at += np.arange(ends[low], ends[high])
            out[ends[low] : ends[high]] = pool[at]
        return out, ends[offsets[1:]] - ends[first]


@functools.cache
def ids_of(name: str = "byte_bpe_50k") -> Ids:
    """One tokenizer per worker process."""
    return Ids(name)


def text_batches(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES):
    """Parts of a batch of at most `most` bytes of text; a longer text alone."""
    from runline.llm import words as W

    _, offsets = W.text_bytes(batch.column(batch.schema.get_field_index(text)))
    for low, high in W.slices(offsets, most):
        yield batch.slice(low, high - low)
