"""Byte-level BPE ids of the tokenizers library, computed in bulk.

The ids are defined by the tokenizers library and its JSON file. The library encodes about
1.2 MB of text a second and core; tiktoken over the rank file of the same vocabulary gives
the same ids six times faster (``tests/llm/test_llm.py`` compares them on every Unicode
code point, on special tokens and on random text). Both files are parameters.

One unsplit piece of text (a pre-token, such as a run of letters) has to be merged as a
whole. Long ones are cut in halves down to leaves, the leaves are encoded in parallel, and
the halves are put together pairwise: the tokens around a join are encoded again in a
window that doubles until its first token is a token of the left half and its last token is
one of the right half. Neighbouring tokens of a valid encoding are a valid pair, and a
sequence is the encoding of its text when all neighbouring pairs are valid, so agreement on
both ends makes the whole exact.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

JSON_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_TOKEN, END_ID = "<|endoftext|>", 50256
LEAF_CHARS = 8192
WINDOW_TOKENS = 8
THREADS = 2


class Vocabulary:
    """Encoder and decoder; one instance per Python worker, see :func:`load`."""

    def __init__(self, json_file: str = JSON_FILE, rank_file: str = RANK_FILE, leaf_chars: int = LEAF_CHARS):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.json_file, self.leaf_chars = json_file, leaf_chars
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_TOKEN: END_ID}
        )
        self.token_bytes = [b""] * (END_ID + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.token_bytes[END_ID] = END_TOKEN.encode()
        self.byte_lengths = np.array([len(token) for token in self.token_bytes], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, special-token strings included as the library does by default."""
        if len(text) > self.leaf_chars and has_long_run(text, self.leaf_chars):
            return np.array(self.encode_long(text), dtype="<u4")
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", errors="replace")

    def encode_long(self, text: str) -> list[int]:
        """Pre-tokens from the tokenizers library; long ones by tree concatenation."""
        pre = pre_tokenizer(self.json_file)
        ids: list[int] = []
        for i, part in enumerate(text.split(END_TOKEN)):
            if i:
                ids.append(END_ID)
            for _, (start, end) in pre.pre_tokenize_str(part) if part else ():
                ids.extend(self.encode_piece(part[start:end]))
        return ids

    def encode_piece(self, piece: str) -> list[int]:
        if len(piece) <= self.leaf_chars:
            return self.encoding.encode_ordinary(piece)
        leaves = [piece[i : i + self.leaf_chars] for i in range(0, len(piece), self.leaf_chars)]
        level = self.encoding.encode_ordinary_batch(leaves, num_threads=THREADS)
        while len(level) > 1:
            joined = [self.join(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = joined + level[len(level) - len(level) % 2 :]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the text of ``left`` followed by the text of ``right``."""
        width = WINDOW_TOKENS
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            while i > 0 and inside_character(self.token_bytes[left[i]]):
                i -= 1
            while j < len(right) and inside_character(self.token_bytes[right[j]]):
                j += 1
            tokens = left[i:] + right[:j]
            window = self.encoding.encode_ordinary(b"".join(self.token_bytes[t] for t in tokens).decode("utf-8"))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            width *= 2


def inside_character(token: bytes) -> bool:
    """Whether a token starts in the middle of a UTF-8 character."""
    return token[0] & 0xC0 == 0x80


def has_long_run(text: str, most: int) -> bool:
    """Whether a pre-token may exceed ``most`` characters: a run with or without white space that long."""
    return max(map(len, text.split()), default=0) >= most or re.search(rf"\s{{{most}}}", text) is not None


@lru_cache(maxsize=4)
def pre_tokenizer(json_file: str):
    return Tokenizer.from_file(json_file).pre_tokenizer


@lru_cache(maxsize=4)
def load(json_file: str = JSON_FILE, rank_file: str = RANK_FILE) -> Vocabulary:
    """The vocabulary of this process."""
    return Vocabulary(json_file, rank_file)
