"""Token ids by the tokenizers library, a word at a time with a cache.

The library is asked once for each distinct piece of text between two places where no token can reach across. For the
byte-level kind such a place lies before each run of white space and after a line break; for the kind that drops white
space, at each run of white space. Ids are those of encoding the whole text (tests compare both on mixed white space).
"""

from __future__ import annotations

import json
import os
import re
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps (about 0.2 kB each), in two halves: when the newer is full it replaces the older, and a
#: piece that is met again moves from the older to the newer.
CACHE = 700_000
#: Bytes of a piece that is kept beyond the texts that hold it.
LONGEST = 64
CLOSING = b".,!?;:#$%&*|"
#: Bytes of text that are looked up together, and of the kind that drops white space, which Arrow splits.
BLOCK, SPLIT_BLOCK = 250_000, 4_000_000
_PIECES = re.compile(rb"[\x20\x09-\x0d]+[^\x20\x09-\x0d]+|[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
_ODD = (b"\0", b"\t", b"\x0b", b"\x0c", b"\r", b"  ", b"\n\n", b" \n", b"\n ")
#: White space beyond ASCII, which may join a run of ASCII white space into one token.
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on, in order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: 256 + i for i, b in enumerate(sorted({*range(256)}.difference(_PLAIN)))}
_ALPHABET_SPACE = chr(_ALPHABET[0x20])
_loaded: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        before = json.loads(self.library.to_str())["pre_tokenizer"] or {}
        parts = before.get("pretokenizers", [before])
        drops = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed"
        spaced = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.kind = "drops" if drops else "spaced" if spaced else "whole"
        lowers = any(n.get("type") == "Lowercase" for n in (json.loads(self.library.to_str())["normalizer"] or {}).get("normalizers", []))
        self.lower = drops and lowers
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def pieces(self, raw: bytes) -> list[bytes]:
        if self.kind == "drops":
            return (raw.lower() if self.lower else raw).split()
        if self.kind == "whole":
            return [raw] if raw else []
        if not raw:
            return []
        if not raw.isascii() and any(w in raw for w in _WIDE) and _WIDE_SPACE.search(raw.decode("utf-8")):
            return [raw]
        if raw[:1].isspace() or raw[-1:].isspace() or any(odd in raw for odd in _ODD):
            return _PIECES.findall(raw)
        return raw.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0").split(b"\0")

    def one_word(self, piece: bytes) -> bool:
        """Whether the piece is letters alone that no normalizer changes, so that the model can be asked directly."""
        word = piece[1:] if self.kind == "spaced" and piece[:1] == b" " else piece
        if word.isalpha():
            return True
        text = word.decode("utf-8")
        return text.isalpha() and max(text) < "\u0250" and (self.kind == "spaced" or text == text.lower() and is_normalized("NFC", text))

    def library_ids(self, pieces: list[bytes]) -> list[bytes]:
        ask, code, whole, one_word = self.library.model.tokenize, self.code, self.kind == "whole", self.one_word
        plain = lambda p: p.decode("ascii").replace(" ", _ALPHABET_SPACE) if p.isascii() else p.decode("latin-1").translate(_ALPHABET)
        direct = [not whole and (p.isalpha() or one_word(p)) for p in pieces]
        rest = [p.decode("utf-8") for p, d in zip(pieces, direct, strict=True) if not d]
        others = iter(self.library.encode_batch_fast(rest, add_special_tokens=False))
        return [array(code, [t.id for t in ask(plain(p))] if d else next(others).ids).tobytes() for p, d in zip(pieces, direct, strict=True)]

    def recall(self, pieces: set[bytes]) -> set[bytes]:
        """Moves pieces from the older half of the cache to the newer; gives those that neither holds."""
        again = self.older.keys() & pieces
        self.cache.update({p: self.older.pop(p) for p in again})
        return pieces - again

    def learn(self, missing: set[bytes]) -> None:
        """Puts the ids of pieces that the cache lacks into it. Closing marks after a letter are tokens of their own."""
        cache = self.cache
        missing = self.recall(missing)
        stems = {}
        if self.kind != "whole":
            stems = {p: s for p in missing if p[-1] in CLOSING and (s := p.rstrip(CLOSING)) and (s[-1:].isalpha() or s.decode("utf-8")[-1].lower().isalpha())}
        wanted = [p for p in missing if p not in stems]
        parts = {x for p, s in stems.items() for x in (s, p[len(s) :])}
        wanted += self.recall(parts.difference(cache, wanted))
        cache.update(zip(wanted, self.library_ids(wanted), strict=True))
        cache.update({p: cache[s] + cache[p[len(s) :]] for p, s in stems.items()})

    def settle(self, missing: set[bytes]) -> None:
        """After a block: forgets long pieces, and the older half when the newer is full."""
        for p in missing:
            if len(p) > LONGEST:
                self.cache.pop(p, None)
        if len(self.cache) > CACHE // 2:
            self.cache, self.older = {}, self.cache

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian integers of ``dtype``."""
        block, bytes_of_block = (self._split_block, SPLIT_BLOCK) if self.kind == "drops" else (self._block, BLOCK)
        out: list[bytes] = []
        at = 0
        while at < len(raws):
            end, size = at, 0
            while end < len(raws) and size < bytes_of_block:
                size += len(raws[end])
                end += 1
            out += block(raws[at:end])
            at = end
        return out

    def _block(self, raws: list[bytes]) -> list[bytes]:
        pieces = [self.pieces(raw) for raw in raws]
        here = set().union(*pieces)
        missing = {p for p in here if p not in self.cache}
        if missing:
            self.learn(missing)
        find = dict(zip(here, map(self.cache.__getitem__, here), strict=True)).__getitem__  # small, so that lookups are fast
        out = [b"".join(map(find, ps)) for ps in pieces]
        self.settle(missing)
        return out

    def _split_block(self, raws: list[bytes]) -> list[bytes]:
        """The same where white space is dropped: Arrow splits the texts, numbers their distinct words and deals out ids."""
        texts = pa.array(raws, pa.binary()).cast(pa.string())
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.lower else texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        cache = self.cache
        cache[b""] = b""  # stands before leading and after trailing white space
        found = [*map(cache.get, distinct)]
        missing = {p for p, ids in zip(distinct, found, strict=True) if ids is None}
        if missing:
            self.learn(missing)
            found = [cache[p] if ids is None else ids for p, ids in zip(distinct, found, strict=True)]
        width = self.dtype.itemsize
        ends = np.cumsum([0, *map(len, found)]) // width
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), self.dtype)))
        dealt = ids.take(coded.indices)
        limits = (dealt.offsets.to_numpy()[words.offsets.to_numpy()] * width).tolist()
        flat = dealt.flatten().to_numpy().tobytes()
        self.settle(missing)
        return [flat[a:b] for a, b in zip(limits, limits[1:])]


def encoder(path: str) -> Encoder:
    """One for each path and worker process, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
