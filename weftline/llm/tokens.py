"""Token ids of whole texts by a public tokenizer file, exactly as the tokenizers library gives them.

A byte-level BPE file encodes each pre-token by itself, and a corpus repeats most of its pre-tokens.  For texts of common
characters the pre-tokens are found with numpy and each distinct one is given to the library once; any other text goes to
the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from typing import Any

import numpy as np
import pandas as pd

from weftline.llm.words import spans

#: Distinct pre-tokens whose ids a task keeps; others are encoded again where they occur.
KEPT = 350_000
_LETTER, _NUMBER, _OTHER, _BLANK, _SPACE, _RARE = 1, 2, 3, 4, 5, 9
#: Code points from here on, and a few below, send a text to the library.
_COMMON = 0x250
_kinds = np.full(_COMMON, _OTHER, np.uint8)
for _c in range(_COMMON):
    _kinds[_c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(_c))[0], _OTHER)
_kinds[[*range(9, 14)]] = _SPACE
_kinds[32] = _BLANK
_kinds[[*range(0x1C, 0x20), 0x85, 0xA0]] = _RARE
_byte_kinds = np.concatenate([_kinds[:128], np.full(128, _RARE, np.uint8)])


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The tokenizer of each file, whether its pre-tokens are found here, and its marks: read once in each Python worker.
_libraries: dict[str, tuple[Any, bool, list[bytes]]] = {}


class Encoder:
    """Encodes batches of texts; the ids of distinct pre-tokens are kept up to ``KEPT``, for as long as the encoder: a task."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = path or _default_path()
        if path not in _libraries:
            with open(path, encoding="utf-8") as f:
                said = json.load(f)
            pre = said.get("pre_tokenizer") or {}
            plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer") and said["model"].get("type") == "BPE"
            _libraries[path] = (Tokenizer.from_file(path), plain, [t["content"].encode() for t in said.get("added_tokens", [])])
        self.library, self.plain, self.marks = _libraries[path]
        self.known = pd.Index(np.zeros(0, np.uint64))  # hashes of kept pre-tokens, by their place
        self.recent: dict[int, int] = {}  # those that are not yet in it
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, texts: list[str]) -> list[list[int]]:
        """The ids of each pre-token.  Many are given to the library as one text, between newlines, which stay apart."""
        line = self.library.encode("\n", add_special_tokens=False).ids
        dark = [i for i, x in enumerate(texts) if not x.isspace()]
        out: list[list[int]] = [[] for _ in texts]
        white = [i for i, x in enumerate(texts) if x.isspace()]
        for i, x in zip(white, self.library.encode_batch_fast([texts[i] for i in white], add_special_tokens=False), strict=True):
            out[i] = x.ids
        groups = [dark[k : k + 500] for k in range(0, len(dark), 500)]
        found = self.library.encode_batch_fast(["\n".join(texts[i] for i in g) for g in groups], add_special_tokens=False)
        for g, x in zip(groups, found, strict=True):
            ids = np.array(x.ids)
            cuts = [-1, *np.flatnonzero(ids == line[0]).tolist(), len(ids)]
            if len(line) != 1 or len(cuts) != len(g) + 1:
                for i, y in zip(g, self.library.encode_batch_fast([texts[i] for i in g], add_special_tokens=False), strict=True):
                    out[i] = y.ids
                continue
            for i, a, b in zip(g, cuts, cuts[1:], strict=False):
                out[i] = ids[a + 1 : b].tolist()
        return out

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """The places of pre-tokens by their hashes; -1 for one that is not kept."""
        if len(self.recent) > max(20_000, len(self.known) // 3):
            self.known = pd.Index(np.concatenate([self.known.to_numpy(), np.fromiter(self.recent, np.uint64, len(self.recent))]))
            self.recent = {}
        where = self.known.get_indexer(hashes).astype(np.int64)
        rest = np.flatnonzero(where < 0)
        if self.recent and len(rest):
            where[rest] = [self.recent.get(h, -1) for h in hashes[rest].tolist()]
        return where

    def encode(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids (uint32) of each text of a batch: UTF-8 bytes and n + 1 offsets."""
        n = len(off) - 1
        if not self.plain:
            return self._library([raw[a:b].tobytes().decode() for a, b in zip(off, off[1:], strict=False)])
        kind = _byte_kinds[raw]
        two = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] < 0xCA)) if len(raw) else np.zeros(0, np.int64)
        point = ((raw[two].astype(np.int32) & 0x1F) << 6) | (raw[two + 1] & 0x3F)
        kind[two] = kind[two + 1] = np.where(point < _COMMON, _kinds[np.minimum(point, _COMMON - 1)], _RARE)
        begin = np.zeros(len(raw), bool)
        heads = off[:-1][off[:-1] < off[1:]]
        if len(raw):
            before, after = np.empty_like(kind), np.empty_like(kind)
            before[1:], after[:-1] = kind[:-1], kind[1:]
            before[heads] = 0
            after[np.append(heads[1:], len(raw)) - 1] = _SPACE
            white, white_before = kind >= _BLANK, before >= _BLANK
            begin = np.where(white, ~white_before | (after < _BLANK), (~white_before & (before != kind)) | (before == _SPACE))
            begin[heads] = True
        # texts that the rules above don't cover
        odd = kind == _RARE
        quote = np.flatnonzero((raw[:-1] == ord("'")) & begin[:-1]) if len(raw) else np.zeros(0, np.int64)
        odd[quote[np.isin(raw[quote + 1], np.frombuffer(b"strmlvd", np.uint8))]] = True
        data = raw.tobytes()
        for mark in self.marks:
            at = data.find(mark)
            while at >= 0:
                odd[at] = True
                at = data.find(mark, at + 1)
        whole = np.zeros(n, bool)
        whole[np.searchsorted(off, np.flatnonzero(odd), "right") - 1] = True

        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(raw))
        of = np.searchsorted(off, start, "right") - 1
        good = ~whole[of]
        start, end, of = start[good], end[good], of[good]
        code, distinct = pd.factorize(spans(raw, start, end))
        where = self._places(distinct)
        new = np.flatnonzero(where < 0)
        flat, first, size = self.flat, self.begin, self.size
        if len(new):
            seen = np.empty(len(distinct), np.int64)
            seen[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            ids = self._pretokens([data[a:b].decode() for a, b in zip(start[seen[new]].tolist(), end[seen[new]].tolist(), strict=True)])
            lengths = np.array([len(x) for x in ids], np.int64)
            where[new] = np.arange(len(new)) + len(size)
            first = np.concatenate([first, np.cumsum(lengths) - lengths + len(flat)])
            flat = np.concatenate([flat, np.array([y for x in ids for y in x], np.uint32)])
            size = np.concatenate([size, lengths])
            room = KEPT - len(self.known) - len(self.recent)
            if room > 0:
                self.recent.update(zip(distinct[new[:room]].tolist(), where[new[:room]].tolist(), strict=True))
                keep = len(self.known) + len(self.recent)
                self.begin, self.size = first[:keep], size[:keep]
                self.flat = flat[: int(first[keep - 1] + size[keep - 1])]
        at = where[code]
        lengths = size[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.arange(total) + np.repeat(first[at] - (ends - lengths), lengths)]
        cuts = np.concatenate([[0], ends])[np.searchsorted(of, np.arange(n + 1))]
        result = [out[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        odd_rows = np.flatnonzero(whole).tolist()
        if odd_rows:
            for i, x in zip(odd_rows, self._library([data[off[i] : off[i + 1]].decode() for i in odd_rows]), strict=True):
                result[i] = x
        return result
