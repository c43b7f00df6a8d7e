"""Token ids of the word BPE vocabulary, through a cache of chunks between white space.

The tokenizer never joins text across white space and drops it, so the ids of a text are those of its chunks one after
the other. Frequent chunks cost one dictionary look-up. A new chunk is split and merged by the vocabulary's own model;
whatever is unusual about it (not in composed form, a letter whose lower case depends on its place, a special token's
string) sends it through the whole tokenizer instead.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: Bytes that a worker's cache may hold before it starts anew, and the longest chunk that is kept.
CACHE_BYTES, LONGEST = 64 << 20, 64
#: What an entry costs beside four bytes a character and its ids.
ENTRY = 220
#: Texts on which the cache has to agree with the whole tokenizer; with another vocabulary it may not, and isn't used then.
PROBES = ("", " ", "Hello, World's end", "it'll I'm 12345 3.14", "a\tb\n\nc  d", "Été naïve Straße ﬁ ΟΔΟΣ", "日本語のテキスト", "x=y+z; foo_bar->baz()", "e\u0301 \u200b \u00a0 -- \"q\" <|x|>", "\U0001f600 ok")
END_ID = 1


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself if printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, nxt = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else nxt))
        nxt += b not in plain
    return out


class Ids:
    """Callable: text -> little-endian unsigned 32-bit ids as bytes, with END_ID at the end."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.known: dict[str, bytes] = {}  # ids of chunks and of their parts; a part's ids are those of the chunk that equals it
        self.held = 0
        self.end = np.array([END_ID], "<u4").tobytes()
        self.cached = all(self(p) == self.slow(p) + self.end for p in PROBES)

    def keep(self, key: str, ids: bytes) -> None:
        """Into the cache, if the key isn't long; it starts anew when it holds CACHE_BYTES."""
        if len(key) > LONGEST or key in self.known:
            return
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        self.known[key] = ids
        self.held += ENTRY + 4 * len(key) + len(ids)

    cached = True

    def __call__(self, text: str | None) -> bytes:
        if not self.cached:
            return self.slow(text or "") + self.end
        pieces = (text or "").replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.known.__getitem__, pieces)) + self.end
        except KeyError:
            out = []
            for c in pieces:
                ids = self.known.get(c)
                if ids is None:
                    ids = self.chunk(c)
                    self.keep(c, ids)
                out.append(ids)
            return b"".join(out) + self.end

    def chunk(self, c: str) -> bytes:
        if c.isascii():
            if "<|" in c:
                return self.slow(c)
            low = c.lower()
        else:
            low = c.lower()
            if len(low) != len(c) or "Σ" in c or not unicodedata.is_normalized("NFC", c) or not unicodedata.is_normalized("NFC", low) or "<|" in c:
                return self.slow(c)
        if low.isalpha():
            return self.part(low)
        return b"".join([self.part(p) for p in self.split(low)])

    def part(self, p: str) -> bytes:
        ids = self.known.get(p)
        if ids is None:
            mapped = p if p.isascii() and p.isprintable() else "".join([self.letters[b] for b in p.encode("utf-8", "surrogatepass")])
            ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            self.keep(p, ids)
        return ids

    def slow(self, c: str) -> bytes:
        return np.array(self.whole.encode(c, add_special_tokens=False).ids, "<u4").tobytes()


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One per Python worker and vocabulary, so that tasks share its cache."""
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
