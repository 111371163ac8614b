"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain, pairwise
from pathlib import Path

import numpy as np

#: Letters, numbers and white space of Latin-1, and with them the
#: pattern by which byte-level BPE vocabularies of this kind cut a text before
#: they merge. Explicit classes are three times as fast as Unicode properties.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = "\t-\r \x85\xa0"
LATIN_CUT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


#: Words whose ids an encoder keeps, some 200 bytes each.
MOST_KEPT = 1_100_000


class Encoder:
    """Encodes texts to little-endian ids in the narrowest unsigned type.

    A byte-level BPE never merges across its cuts, so the ids of a text are
    those of its cuts in turn. Words repeat, so each new word goes through the
    tokenizers library once (whole batches of them) and its ids are kept in a
    table that is emptied when it has ``most_kept`` words. Texts beyond Latin-1,
    texts that hold the string of an added token (which the library cuts out
    before anything else), and tokenizers of any other kind, go through the
    library as they are.
    """

    def __init__(self, path: str, most_kept: int = MOST_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.most_kept = most_kept
        self.kept: dict[str, bytes] = {}
        spec = json.loads(Path(path).read_text())
        pre = spec.get("pre_tokenizer") or {}
        self.by_cut = (
            spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
        )
        self.cut = re.compile(LATIN_CUT).findall
        self.plain = re.compile(rf" [{LETTERS}]+").fullmatch
        added = [x["content"] for x in spec.get("added_tokens") or () if x["content"]]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        # Plain words are encoded as one text, in which no added token may arise.
        self.by_cut = self.by_cut and not any(re.fullmatch(f"[ {LETTERS}]+", x) for x in added)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Like ``_whole``; words of a space and letters go as one text, which is cut just so."""
        out = dict.fromkeys(words, b"")
        joined = [w for w in words if self.plain(w)]
        for at in range(0, len(joined), 4096):
            some = joined[at : at + 4096]
            found = self.tokenizer.encode("".join(some), add_special_tokens=False)
            ids, word = np.array(found.ids, dtype=self.dtype), np.array(found.word_ids)
            ends = (np.flatnonzero(np.diff(word, prepend=-1, append=-1)) * self.dtype.itemsize).tolist()
            all_ids = ids.tobytes()
            out.update(zip(some, [all_ids[i:j] for i, j in pairwise(ends)], strict=True))
        rest = [w for w in words if not self.plain(w)]
        out.update(zip(rest, self._whole(rest), strict=True))
        return list(out.values())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``."""
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            out += self._some(texts[at : at + 256])
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        if not self.by_cut:
            return self._whole(texts)
        cuts: list[list[str] | None] = []
        for text in texts:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                cuts.append(None)
            else:
                cuts.append(None if self.added(text) else self.cut(text))
        if len(self.kept) > self.most_kept:
            self.kept.clear()
        kept = self.kept
        new = [w for w in set(chain.from_iterable(words for words in cuts if words)) if w not in kept]
        if new:
            kept.update(zip(new, self._words(new), strict=True))
        rest = iter(self._whole([t for t, words in zip(texts, cuts, strict=True) if words is None]))
        return [next(rest) if words is None else b"".join(map(kept.__getitem__, words)) for words in cuts]


@lru_cache(maxsize=2)
def encoder(path: str, most_kept: int = MOST_KEPT) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, most_kept)


def crc32_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
