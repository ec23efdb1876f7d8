"""Token ids by the tokenizers library, one library call for each distinct pre-token.

BPE merges never cross pre-tokens, so a text's ids are the ids of its pre-tokens in a row. Pre-tokens are found
here by the tokenizer's own pattern, spelt out for characters whose classes are beyond doubt (ASCII, Latin-1,
Latin Extended-A and general punctuation); each distinct one goes to the library once and its ids are kept in a
bounded table. A text with any other character, or a tokenizer of another kind, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from . import common

# Letters and numbers among the characters of _PLAIN, as Unicode has them.
_L = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-ſ"
_N = "0-9²³¹¼-¾"
_S = " \\t\\n\\r"
#: What is not plain; soft hyphens and space-like characters are left to the library too.
_NOT_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-¬®-įı-ňŊ-ſ‐-‧]")



def _byte_chars() -> dict[int, str]:
    """Each plain character as byte-level models spell its UTF-8 bytes: printable bytes as themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelt = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in [*range(0x180), *range(0x2010, 0x2028)]}


_AS_BYTES = _byte_chars()
_BYTE_LEVEL = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Seen(dict):
    """Word -> number; new words are numbered as they come and remembered in `new`."""

    new: list[str]

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    #: Distinct pre-tokens kept; at more the table starts anew, which changes speed only.
    KEEP = 300_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split, self.lower = self._rule(spec)
        self._reset()

    @staticmethod
    def _rule(spec: dict):
        norm, pre = spec["normalizer"], spec["pre_tokenizer"] or {}
        if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return re.compile(_BYTE_LEVEL).findall, False
        steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
        inner = pre.get("pretokenizers", [{}])
        if steps == ["NFC", "Replace", "Lowercase"] and inner[0].get("pattern") == {"Regex": _WORD_SPLIT} and inner[0]["invert"] and inner[0]["behavior"] == "Removed":
            return re.compile(_WORD_SPLIT.replace(r"\p{L}", _L).replace(r"\p{N}", _N).replace(r"\s", _S)).findall, True
        return None, False

    def _reset(self) -> None:
        self.seen = _Seen()
        self.seen.new = []
        self.flat = np.empty(1 << 16, np.int32)
        self.starts = np.zeros(self.KEEP // 4 + 2, np.int64)
        self.n = 0

    def _learn(self) -> None:
        new, self.seen.new = self.seen.new, []
        for k in range(0, len(new), 20_000):
            got = [[t.id for t in self.tok.model.tokenize(w.translate(_AS_BYTES))] for w in new[k : k + 20_000]]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            ids = np.fromiter((i for g in got for i in g), np.int32, int(lens.sum()))
            at = int(self.starts[self.n])
            while at + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while self.n + len(got) + 1 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.flat[at : at + len(ids)] = ids
            self.starts[self.n + 1 : self.n + len(got) + 1] = at + np.cumsum(lens)
            self.n += len(got)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (int32), and the count for each text (int64)."""
        if len(self.seen) > self.KEEP:
            self._reset()
        pieces: list[str] = []
        n_words = np.zeros(len(texts), np.int64)
        whole: dict[int, np.ndarray] = {}
        for k, t in enumerate(texts):
            if self.split is None or _NOT_PLAIN.search(t):
                whole[k] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int32)
                continue
            found = self.split(t.lower() if self.lower else t)
            n_words[k] = len(found)
            pieces += found
        which = np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))
        if self.seen.new:
            self._learn()
        begin = self.starts[which]
        lens = self.starts[which + 1] - begin
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(begin - (ends - lens), lens)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        counts = np.diff(upto)
        if whole:
            runs, last = [], 0
            for k, w in whole.items():
                runs += [ids[last : upto[k]], w]
                last, counts[k] = upto[k], len(w)
            ids = np.concatenate([*runs, ids[last:]])
        return ids, counts


def encoder(path: str) -> Encoder:
    """A worker process's encoder of a file. Its arrays are many and large, so only larger ones are given back at once."""
    common.lean_memory(8)
    return common.resident(("encoder", path), lambda: Encoder(path))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
