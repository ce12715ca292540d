"""Token ids of whole texts with a public tokenizer file, memoised by the pieces between white space.

The tokenizer never joins text across white space, so ids of plain Latin text are the joined ids of its pieces.
Pieces are found and hashed in whole columns (``textkit``); ids of those met before are gathered from one array, the
others are encoded together, as one text with spaces between.
Text outside the plain range, or holding a special string or a piece of over ``LONGEST`` bytes, goes to the tokenizer
as it is.  (Hashes have 64 bits; below that length no two pieces are known that share one by construction.)
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from graphloom.llm.textkit import U64, slices, word_places

#: Characters for which the file's normaliser is plain lower-casing and white space only separates.
PLAIN = r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-įĲ-ňŊ-ž‐-‧]"
_PLAIN = re.compile(PLAIN + "*+")
#: Fixed by the tokenizer file: its pre-tokens, for lower-cased text of these characters.
_PRETOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ž]+|[0-9]|[^\sa-zß-öø-ž0-9]+")
LONGEST = 1000
#: Pieces remembered by a worker; when they are more, the half used last is kept.
MEMO = 400_000
SLICE_BYTES = 400_000


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.has_special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.IGNORECASE).search
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids that end a pre-token
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>") or t in special]] = True
        # The memory: hashes in order, each with its piece's ids in ``ids`` and the slice that used it last.
        self.keys, self.first, self.count, self.used = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.now = np.zeros(0, np.dtype("<u4")), 0
        probe = "It's PLAIN:  42 déjà-vu\n\ttests, 'don't' 3.5% … x'll!"
        self.splits = self._whole([probe])[0].tolist() == self._encode_pieces(probe.split())[0].tolist()  # a file with other rules is used without the memory

    def _whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(list(texts), add_special_tokens=False)]

    def _encode_pieces(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        last = np.cumsum([len(_PRETOKEN.findall(p.lower())) for p in pieces])
        if not len(ends) or len(ends) != last[-1] or ends[-1] != len(ids):  # a file that marks no ends
            own = self._whole(pieces)
            return np.concatenate(own), np.asarray([len(x) for x in own])
        return ids, np.diff(np.append(0, np.append(0, ends)[last]))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.splits and _PLAIN.fullmatch(t) and not self.has_special(t)]
        for first, last, raw, bounds in slices(pa.array([texts[i] for i in plain], pa.large_string()), SLICE_BYTES):
            hashes, starts, lengths = word_places(raw, bounds)
            at = np.searchsorted(starts, bounds)
            place = self._learn(hashes, starts, lengths, raw)
            n = self.count[place]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = self.ids[np.repeat(self.first[place] - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[at]
            fits = np.maximum.reduceat(np.append(lengths, 0), np.minimum(at[:-1], len(lengths))) <= LONGEST if len(lengths) else np.ones(last - first, bool)
            for k in range(last - first):
                if fits[k] or at[k] == at[k + 1]:
                    out[plain[first + k]] = ids[cuts[k] : cuts[k + 1]].tobytes()
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]) if rest else (), strict=True):
            out[i] = ids.tobytes()
        return out

    def _learn(self, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """The place of each piece in the memory, after unknown ones were encoded."""
        self.now += 1
        wanted, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, wanted)
        known = np.append(self.keys, U64(0))[spot] == wanted
        known[spot == len(self.keys)] = False
        self.used[spot[known]] = self.now
        if not known.all():
            at = example[~known]
            pieces = [raw[a : a + n].tobytes().decode() if n <= LONGEST else "x" for a, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
            if len(self.keys) + len(at) > MEMO:
                self._forget()
                spot = np.searchsorted(self.keys, wanted)
            ids, count = self._encode_pieces(pieces)
            new = spot[~known]
            self.first = np.insert(self.first, new, len(self.ids) + np.cumsum(count) - count)
            self.keys, self.count, self.used = np.insert(self.keys, new, wanted[~known]), np.insert(self.count, new, count), np.insert(self.used, new, self.now)
            self.ids = np.concatenate([self.ids, ids])
            spot = np.searchsorted(self.keys, wanted)
        return spot[which]

    def _forget(self) -> None:
        """Keep what this slice uses and the half used last."""
        keep = self.used >= min(self.now, int(np.median(self.used)) + 1)
        n = self.count[keep]
        ends = np.concatenate([[0], np.cumsum(n)])
        self.ids = self.ids[np.repeat(self.first[keep] - ends[:-1], n) + np.arange(ends[-1])]
        self.keys, self.first, self.count, self.used = self.keys[keep], ends[:-1], n, self.used[keep]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
