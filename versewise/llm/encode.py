"""Token ids of texts by a file of the tokenizers library, fast on repeated words.

Byte-level BPE cuts a text into words first and merges bytes only within a
word, so ids of a word don't depend on its neighbours. The encoder keeps the
ids of words it has met; each new word is encoded once by the library. Texts
that hold a special token, and tokenizers of another kind, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

#: Where a text may be cut: a space between two characters that aren't white space.
EDGE = regex.compile(r"(?<=\S)(?= \S)")
#: Fixed: the word pattern of byte-level BPE files with ``use_regex``.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ENCODERS: dict[str, "Encoder"] = {}


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters for themselves, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder(path: str) -> "Encoder":
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """``keep``: so many words and spaced parts are remembered at most; the
    memory is then emptied, which costs time but changes no result."""

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.vocab_size = max(vocab.values()) + 1
        self.by_word = (spec.get("normalizer") is None and spec["model"]["type"] == "BPE"
                        and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                        and not pre.get("add_prefix_space"))
        self.model, self.alphabet = self.tok.model, byte_alphabet()
        self.keep, self.words, self.parts, self.heads = keep, {}, {}, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word by the library's model, in the byte alphabet."""
        found = self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))
        return np.array([t.id for t in found], "<u4").tobytes()

    def _part(self, body: str, space: str) -> bytes | None:
        """Ids of what stands between two spaces, with the space before it (a
        text's first part has none); None where white space meets the space,
        as the words there depend on both sides."""
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        out = []
        for w in WORDS.findall(space + body):
            ids = self.words.get(w)
            if ids is None:
                ids = self.words[w] = self._word(w)
            out.append(ids)
        return b"".join(out)

    def _by_edges(self, text: str) -> bytes:
        return b"".join(self._word(w) for p in EDGE.split(text) for w in WORDS.findall(p))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text (none for null or empty)."""
        if len(self.parts) + len(self.heads) > self.keep:
            self.parts, self.heads = {}, {}
        if len(self.words) > self.keep:
            self.words = {}
        out, parts = [], self.parts
        for t in texts:
            if not t:
                out.append(b"")
                continue
            if not self.by_word or any(s in t for s in self.special):
                out.append(self._whole(t))
                continue
            cut = t.split(" ")
            head, rest = cut[0], cut[1:]
            if head not in self.heads:
                self.heads[head] = self._part(head, "")
            for p in set(rest).difference(parts):
                parts[p] = self._part(p, " ")
            got = [self.heads[head], *[parts[p] for p in rest]]
            out.append(self._by_edges(t) if None in got else b"".join(got))
        return out
