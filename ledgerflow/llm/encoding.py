r"""Token ids of whole texts, as the tokenizers library gives them for a vocabulary file.

The library merges each pre-token with a heap, which is most of the time of a run over invented
or multilingual prose. Two kinds of files allow a faster way to the same ids:

* ``byte``: byte-level BPE with the usual pattern, no normaliser, no prefix space. tiktoken
  takes the ranks straight from the file's vocabulary (its ids are merge ranks, which is tested).
* ``word``: BPE with word ends whose pattern drops white space. A text is cut at blanks
  and line feeds, which no token spans and over which neither the normaliser nor a lower case looks; a unit's ids are cached.
  A new unit is cut with the pattern and merged by tiktoken with the word end as a byte 0xFF behind it (no UTF-8
  text holds that byte, and the merges with it come first in the file), if each of its characters is ASCII or known: the library
  normalises and lower-cases it as Python does, and counts it to the same of letters, digits, white space and others, all that the
  pattern asks. That is looked up in the library once for each character. Characters that Python does not know, or that may
  join with the one before them, are never known, and a unit with any other character is encoded by the library.

Texts with a special string, and for ``byte`` those with a very long run of white space (tiktoken's regex engine
keeps a stack entry for each character of it, and panics at about a million), go to the library, as do all texts of any
other file, and any text at which tiktoken panics all the same. What decides is the text or the unit itself, never what a
worker has met before. The tests hold both ways against the library over all code points.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata

import numpy as np

CACHE_UNITS = 1 << 19  # about 100 MB; units seen first are the frequent ones and stay
LONG_SPACE = 100_000  # characters of white space in a run that are left to the library
# The patterns of the two kinds.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_SPACES = re.compile(r"\s+")
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a vocabulary file, one per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of byte-level vocabularies: printable bytes are themselves, the others
    follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def split_rule(spec: dict) -> str:
    """``byte``, ``word`` or ``whole``: which of the ways above a tokenizer's description allows."""
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback")
            or model.get("ignore_merges") or model.get("continuing_subword_prefix")):
        return "whole"
    end, start = model.get("end_of_word_suffix"), 256
    if (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and not end):
        rule = "byte"
    else:
        parts = pre.get("pretokenizers") or [{}]
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if not (parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": WORD_PATTERN} and end == WORD_END
                and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
                and steps == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[1].get("type") == "ByteLevel"
                and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")):
            return "whole"
        rule, start = "word", 512
    vocabulary = model["vocab"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    in_order = all(vocabulary.get(a + b) == start + i for i, (a, b) in enumerate(pairs))
    spaces = any(re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return rule if in_order and not spaces else "whole"


def long_space(text: str) -> bool:
    """Whether a run of white space is too long for tiktoken."""
    return len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in _SPACES.finditer(text))


def joining() -> frozenset[str]:
    """The characters that normalising may join with the one before them: marks, and second halves of canonical pairs."""
    out = {chr(c) for c in range(0x1160, 0x1200)}  # vowels and finals of Hangul
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c):
            out.add(c)
        if parts and parts[0] != "<" and " " in parts:
            out.add(chr(int(parts.split()[1], 16)))
    return frozenset(out)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        self.rule = split_rule(spec)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache: dict[str, bytes] = {"": b""}
        if self.rule != "whole":
            import regex
            import tiktoken

            letters, ranks = byte_letters(), {}
            added = {t["id"] for t in spec["added_tokens"]}
            for token, i in spec["model"]["vocab"].items():
                if i in added:
                    continue
                word_end = self.rule == "word" and token.endswith(WORD_END)
                stem = token[:-len(WORD_END)] if word_end else token
                ranks[bytes(letters[c] for c in stem) + b"\xff" * word_end] = i
            self.merger = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.pattern = regex.compile(WORD_PATTERN)
            self.known: dict[str, bool] = {"\u03a3": False}  # its lower case depends on its place
            self.joining = joining() if self.rule == "word" else frozenset()
            del spec, ranks

    def _library(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 256):
            for e in self.tokenizer.encode_batch_fast(texts[k:k + 256], add_special_tokens=False):
                out.append(struct.pack(f"<{len(e.ids)}I", *e.ids))
        return out

    def _is_known(self, c: str) -> bool:
        """Whether Python and the library treat a character beyond ASCII alike, wherever it stands."""
        if c not in self.known:
            plain = unicodedata.normalize("NFC", c).lower()
            same = unicodedata.category(c) != "Cn" and c not in self.joining and self.tokenizer.normalizer.normalize_str(c) == plain
            for beside in "a1?":  # a letter, a digit or another character runs on with its own kind only
                text = beside + plain + beside
                theirs = [len(piece) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
                same = same and theirs == [len(piece.encode()) for piece in self.pattern.findall(text)]
            self.known[c] = same
        return self.known[c]

    def _own_way(self, unit: str) -> bool:
        return unit.isascii() or all(c.isascii() or self._is_known(c) for c in unit)

    def _unit(self, unit: str) -> bytes:
        """The ids of a unit of known characters."""
        ids: list[int] = []
        plain = unit if unit.isascii() else unicodedata.normalize("NFC", unit)
        for piece in self.pattern.findall(plain.lower()):
            ids += self.merger._encode_single_piece(piece.encode() + b"\xff")
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> bytes:
        """The ids of one text of the ``word`` kind, by its units."""
        units = text.replace("\n", " ").split(" ")
        cache = self.cache
        new = [u for u in set(units) if u not in cache]
        if not new:
            return b"".join(map(cache.__getitem__, units))
        other = [u for u in new if not self._own_way(u)]
        found = dict(zip(other, self._library(other)))
        found.update((u, self._unit(u)) for u in new if u not in found)
        if len(cache) + len(found) <= CACHE_UNITS:
            cache.update(found)
            return b"".join(map(cache.__getitem__, units))
        return b"".join([cache[u] if u in cache else found[u] for u in units])

    def _own(self, text: str) -> bytes:
        """The ids of one text by the faster way, by the library if tiktoken panics."""
        try:
            if self.rule == "word":
                return self._words(text)
            return np.array(self.merger.encode_ordinary(text), "<u4").tobytes()
        except BaseException as e:  # a panic of the Rust code is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return self._library([text])[0]

    def _fast(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.specials) or (self.rule == "byte" and long_space(t))]
        rest = dict(zip(odd, self._library([texts[i] for i in odd])))
        return [rest[i] if i in rest else self._own(t) for i, t in enumerate(texts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.rule == "whole":
            return self._library(texts)
        return self._fast(texts)
