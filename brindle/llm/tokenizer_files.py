"""Exact, fast encoding with the public word-level BPE vocabulary: cached words, tree concatenation for long unsplit text.

The vocabulary file splits a text into words before its merges, so a word's ids are computed once and looked up after
that. Texts with characters outside the Latin range whose normalisation and classes are spelt out below go through the
library itself. A word longer than LONG_WORD is encoded by halves (see tree_encode).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np

EXTRA = "‐‑‒–—‘’‚“”„•…€"
#: NFC leaves these as they are, and Python's lower() and the classes below agree with the library's on them.
PLAIN = re.compile(rf"[\x00-\x1b\x20-\x84\x86-į{EXTRA}]*")
_LETTER = "a-zªµºß-öø-ı"
_DIGIT = "0-9²³¹¼-¾"
WORD = re.compile(rf"[{_LETTER}]+|[{_DIGIT}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTER}{_DIGIT}]+")
LONG_WORD = 2048
#: what Python holds for a word and its ids besides their bytes: two objects and a place in a growing dict
ENTRY_BYTES = 220


def _byte_letters() -> list[str]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


#: ids, and how many byte letters each one has
Tokens = tuple[np.ndarray, np.ndarray]


class WordEncoder:
    """encode(text) gives ids as little-endian unsigned 32-bit bytes; decode(ids bytes) gives the library's decoded text."""

    def __init__(self, path: str, cache_bytes: int = 64 << 20):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ending = BPE(vocab=vocab, merges=merges, end_of_word_suffix=model["end_of_word_suffix"])
        self.open = BPE(vocab=vocab, merges=merges)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.letters = _byte_letters()
        self.most, self.held = cache_bytes, 0
        self.cache: dict[str, bytes] = {}
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.names = [(self.tok.id_to_token(i) or "") for i in range(size)]
        self.vocab_size = size

    def _word(self, word: str) -> bytes:
        if len(word) > LONG_WORD:
            return np.array(self.encode_unsplit(word), "<u4").tobytes()
        return np.array([t.id for t in self.ending.tokenize(word_letters(word, self.letters))], "<u4").tobytes()

    def _segment(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text):
            if not self._has_long_word(text):
                return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            import regex

            normal = self.tok.normalizer.normalize_str(text)
            words = regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", normal)
            return b"".join([self.encode_word(w) for w in words])
        # no word lies across white space, so what stands between it is looked up as one
        runs, cache = text.lower().split(), self.cache
        try:
            return b"".join([cache[r] for r in runs])
        except KeyError:
            pass
        fresh = {r: self._run(r) for r in set(runs) if r not in cache}
        out = b"".join([cache[r] if r in cache else fresh[r] for r in runs])
        for r, ids in fresh.items():
            self._keep(r, ids)
        return out

    def _keep(self, word: str, ids: bytes) -> None:
        """Remembers a short word's ids; all are forgotten when they take more than `cache_bytes`."""
        if len(word) > 64:
            return
        self.held += ENTRY_BYTES + len(word) + len(ids)
        if self.held > self.most:
            self.cache.clear()
            self.held = ENTRY_BYTES + len(word) + len(ids)
        self.cache[word] = ids

    def _run(self, run: str) -> bytes:
        if run.isalpha() and len(run) <= LONG_WORD:
            found = self.ending.tokenize(run if run.isascii() else word_letters(run, self.letters))
        elif len(run) > LONG_WORD:
            return b"".join([self._word(w) for w in WORD.findall(run)])
        else:
            found = [t for w in WORD.findall(run) for t in self.ending.tokenize(w if w.isascii() and w.isprintable() else word_letters(w, self.letters))]
        return pack(f"<{len(found)}I", *[t.id for t in found])

    @staticmethod
    def _has_long_word(text: str) -> bool:
        return len(text) > LONG_WORD and re.search(rf"\S{{{LONG_WORD + 1}}}", text) is not None

    def encode_word(self, word: str) -> bytes:
        found = self.cache.get(word)
        if found is None:
            found = self._word(word)
            self._keep(word, found)
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special_re is None or "<|" not in text:
            return self._segment(text)
        out = []
        for part in self.special_re.split(text):
            if part in self.specials:
                out.append(np.array([self.specials[part]], "<u4").tobytes())
            elif part:
                out.append(self._segment(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    # -- tree concatenation -----------------------------------------------------------------------------------------

    def encode_unsplit(self, word: str, leaf: int = 1024) -> list[int]:
        """Ids of one word of any length."""
        return self.tree(word_letters(word, self.letters), True, leaf)[0].tolist()

    def tree(self, text: str, ends: bool, leaf: int) -> Tokens:
        """The tokens of text; ends: whether the word ends with it. Halves are encoded and then joined."""
        cuts = [*range(0, len(text), leaf), len(text)]
        return self.joined(text, cuts, [self._leaf(text[a:b], ends and b == len(text)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], ends)

    def joined(self, text: str, cuts: list[int], parts: list[Tokens], ends: bool) -> Tokens:
        """Neighbours of parts, the tokens of text between cuts, are joined until one is left."""
        while len(parts) > 1:
            pairs = range(0, len(parts) - 1, 2)
            rest = parts[-1:] if len(parts) % 2 else []
            parts = [self.join(text, parts[i], cuts[i + 1], parts[i + 1], ends) for i in pairs] + rest
            cuts = [*cuts[:-1:2], cuts[-1]]
        return parts[0] if parts else self._leaf("", ends)

    def _leaf(self, text: str, ends: bool) -> Tokens:
        found = (self.ending if ends else self.open).tokenize(text) if text else []
        sizes = np.array([len(t.value) for t in found], np.uint32)
        if ends and found:
            sizes[-1] -= len("</w>")
        return np.array([t.id for t in found], np.uint32), sizes

    def join(self, text: str, left: Tokens, mid: int, right: Tokens, ends: bool) -> Tokens:
        """The tokens of a stretch of text from those of its halves, which meet at mid.

        The last k tokens of the left and the first k of the right half are encoded together, with k growing, until
        the first token of the result is the left half's and the last one is the right half's. Each two neighbours of
        the whole are then neighbours in some encoding, and greedy merging of a pair of tokens inside a longer text
        takes the same merges in the same order as alone until one crosses into a third; so none ever does, and the
        whole is what encoding it at once gives. With k as long as a half, it is encoded from that end.
        """
        n, k = len(left[0]), 4
        while True:
            a, b = n - min(k, n), min(k, len(right[0]))
            start, stop = mid - int(left[1][a:].sum()), mid + int(right[1][:b].sum())
            new = self._leaf(text[start:stop], ends and stop == len(text))
            # places: of the first and the last token that both encodings have, if they have them
            left_ok = a == 0 or (len(new[0]) > 0 and all(x[0] == y[a] for x, y in zip(new, left, strict=True)))
            right_ok = b == len(right[0]) or (len(new[0]) > 0 and all(x[-1] == y[b - 1] for x, y in zip(new, right, strict=True)))
            if left_ok and right_ok:
                return tuple(np.concatenate([x[:a], w, y[b:]]) for x, w, y in zip(left, new, right, strict=True))
            k *= 2


def word_letters(word: str, letters: list[str]) -> str:
    return "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One a worker process."""
    return WordEncoder(path)
