"""Token ids of a byte-level BPE tokenizer file: texts are cut before each run of white space, each distinct chunk is encoded once.

No piece of byte-level BPE has white space behind another character, and how a run of white space is divided depends on the run and
on what follows it. A chunk has both, so the ids of a text are those of its chunks. Chunks are looked up by their text, so equal
ids mean equal chunks. The merges of a new chunk's pieces are done by ranks where the file's merges come in the order of the ids
they make (which is looked at when the file is read), else by the tokenizer.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

_PIECES = regex.compile(public_tokenizers.PATTERN)

# fixed values: the characters with the Unicode property White_Space
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_WHITE}]+[^{_WHITE}]*|[^{_WHITE}]+")

#: Longer chunks are encoded where they stand and not kept.
KEPT_CHARS = 256


def _byte_signs() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _by_ranks(path: str) -> tuple[Callable[[str], list[int]], Callable[[bytes], list[int]]] | None:
    """Ids of a text and of a piece by the ranks of merges; None where the file's ids are not in the order of its merges."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, signs = content["model"], _byte_signs()
    special = {t["content"] for t in content.get("added_tokens", ())}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    made = [model["vocab"].get("".join(pair), -1) for pair in pairs]
    ordinary = {t: i for t, i in model["vocab"].items() if t not in special}
    single = [i for t, i in ordinary.items() if len(t) == 1]
    plain = not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("dropout")
    if not plain or len(single) != 256 or made != sorted(made) or max(single) > made[0] or len(ordinary) != 256 + len(set(made)):
        return None
    ranks = {bytes(signs[c] for c in t): i for t, i in ordinary.items()}
    ranked = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ranked.encode_ordinary, ranked._encode_single_piece


@cache
def _loaded(path: str) -> tuple:
    """What a file holds: of fixed size, so a worker keeps it."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
    return tokenizer, _by_ranks(path)


class Encoder(dict):
    """Ids by chunk: those of up to ``limit`` distinct chunks, and of the last ``limit`` before them, so its memory is bounded.

    The tokenizer's tables of letters and digits may be older than those of the pattern here. Each character beyond ASCII is
    tried once; a chunk with one on which they differ is given to the tokenizer.
    """

    def __init__(self, path: str, limit: int = 200_000):
        super().__init__()
        self.tokenizer, self.by_ranks = _loaded(path)
        self.limit = limit
        self.before: dict[str, bytes] = {}
        self.agreed: dict[str, bool] = {}

    def _agrees(self, sign: str) -> bool:
        if sign not in self.agreed:
            probe = f"a{sign}1{sign} {sign}"
            spans = [s for _, s in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            self.agreed[sign] = [probe[a:b] for a, b in spans] == _PIECES.findall(probe)
        return self.agreed[sign]

    def _ids(self, chunk: str) -> bytes:
        if self.by_ranks is None or not (chunk.isascii() or all(map(self._agrees, chunk))):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        text, piece = self.by_ranks
        if chunk.isascii():
            return array("I", text(chunk)).tobytes()
        return array("I", chain.from_iterable(piece(p.encode()) for p in _PIECES.findall(chunk))).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk) or self._ids(chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends): text k has ids[ends[k - 1] : ends[k]]."""
        raw = [b"".join(map(self.__getitem__, _CHUNK.findall(t))) for t in texts]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64) // 4
        return np.frombuffer(b"".join(raw), "<u4"), ends
