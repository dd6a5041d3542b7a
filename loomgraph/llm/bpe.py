"""Byte-pair encoding exactly as the tokenizers library does it, at corpus speed.

A text is cut at *safe boundaries*: before a space that a non-space follows. The
byte-level pre-tokenizer always ends a piece there, whatever stands around it,
so the segments between safe boundaries can be encoded one by one.

Two libraries share the work. Encoding over ranks is several times as fast but
has its own tables of what a letter, digit or space is; it gets the segments
whose characters all lie in blocks where these tables are settled.

Ids travel packed as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np

# The pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no space of any kind follows another. It looks at nothing around a match, so that it runs several times as fast.
LONE_SPACES = PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")
_SPACES = re.compile(r"[\t-\r\x1c-\x20\x85\xa0]{2}")
#: Below this code point the two libraries' tables of letters, digits and spaces are the same for good.
SETTLED = "ɏ"
_BEYOND = re.compile(f"[^\0-{SETTLED}]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Codec:
    """Encodes and decodes with one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.pieces = {}
        for token, i in model["vocab"].items():
            self.pieces[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.fast = self._ranked(spec, PATTERN)
        self.faster = self._ranked(spec, LONE_SPACES)
        self.none: set[str] = set()
        self.lengths = {i: len(p) for i, p in self.pieces.items()}

    def _ranked(self, spec: dict, pattern: str):
        """An encoder over ranks, if the file is plain byte-level BPE whose ids follow its merges; else None."""
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not byte_level or spec.get("normalizer") or model.get("ignore_merges"):
            return None
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {p: i for i, p in self.pieces.items() if i not in self.special.values()}
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def splits(self) -> bool:
        """Whether safe boundaries are known for this vocabulary."""
        return self.fast is not None

    @staticmethod
    def _runs(text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text that meet at safe boundaries, and whether each has letters beyond those the two libraries agree on."""
        if text.isascii() or not _BEYOND.search(text):
            yield text, False
            return
        lo, begin, kind = 0, 0, None
        while lo < len(text):  # neighbouring segments of a kind stay together
            hi = safe_cut(text, lo + 1)
            odd = _BEYOND.search(text, lo, hi) is not None
            if kind is not None and odd != kind:
                yield text[begin:lo], kind
                begin = lo
            lo, kind = hi, odd
        yield text[begin:], kind

    def _ranks(self, text: str) -> np.ndarray:
        """Ids of a text of settled characters."""
        core = self.fast if _SPACES.search(text) else self.faster
        return np.frombuffer(core._core_bpe.encode_to_tiktoken_buffer(text, self.none), np.uint32)

    def _direct(self, text: str) -> bytes:
        """Ids of a text without special strings: by ranks where the libraries' letter tables are settled, else segment by segment."""
        if not text:
            return b""
        return b"".join(self._library(part) if odd else self._ranks(part).tobytes() for part, odd in self._runs(text))

    def _library(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text, special strings inside it taken as special tokens, as the library does."""
        if not text:
            return b""
        if self.fast is None:
            return self._library(text)
        for s, i in self.special.items():
            if s in text:
                return np.uint32(i).tobytes().join(self.encode(part) for part in text.split(s))
        return self._direct(text)

    def lengths_of(self, texts: list[str]) -> list[int]:
        """Numbers of ids: by ranks where that is settled, all the batch's other parts in one call of the library."""
        out, odd, of = [0] * len(texts), [], []
        for i, t in enumerate(texts):
            if self.fast is None or any(s in t for s in self.special):
                runs = [(t, True)]
            else:
                runs = self._runs(t)
            for part, strange in runs:
                if strange:
                    odd.append(part)
                    of.append(i)
                else:
                    out[i] += len(self._ranks(part))
        for i, ids in zip(of, self.library.encode_batch_fast(odd, add_special_tokens=False) if odd else (), strict=True):
            out[i] += len(ids)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD, as in the library."""
        return b"".join(map(self.pieces.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec a worker process and file."""
    return Codec(path)


def safe_cut(text: str, at: int) -> int:
    """The first safe boundary at or after a position, or the text's length."""
    while True:
        at = text.find(" ", at)
        if at < 0 or at + 1 >= len(text):
            return len(text)
        if not text[at + 1].isspace():
            return at
        at += 1
