"""Encoding of whole texts with a tokenizers file, one library call per distinct piece of text.

For tokenizers that lower-case, split at white space and drop it (see ``splits``), the ids of a text are
those of its white-space-separated chunks, one after another; a chunk of ASCII and Latin-1 letters, digits and signs further
splits where their kind changes.  Each worker keeps the ids of pieces that it has met, so a piece is encoded once.  Chunks with
anything else (apostrophes, other scripts, marks, special tokens, control characters) are encoded whole.  Byte-level files that
split as GPT-2's does (see ``byte_level``) keep white space: there a piece has the space before it, white space makes pieces of its own, and
texts with other white space than ASCII's or with special tokens go to the library whole.  With any other tokenizer file all texts do.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd

from tracewell.llm import _text

MOST_KEPT = 1_200_000  # pieces; then the store starts anew, so a worker's memory is bounded
_CLASS = np.full(256, 4, np.uint8)
for _b in range(33, 127):
    _CLASS[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 3
_CLASS[ord("'")] = 4
_CLASS[_text.WHITE] = 0
_ODD = np.uint64(0x5851F42D4C957F2D)
_STORES: dict = {}


#: How a tokenizer must split for its pieces to be encoded apart.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits(rules: dict) -> bool:
    """Does a tokenizer file lower-case, squeeze white space, split as above and mark word ends?"""
    steps = lambda x, many: (x or {}).get(many, [x] if x else [])
    norms = [n["type"] for n in steps(rules.get("normalizer"), "normalizers")]
    blanks = [(n["pattern"].get("Regex"), n["content"]) for n in steps(rules.get("normalizer"), "normalizers") if n["type"] == "Replace"]
    pre = steps(rules.get("pre_tokenizer"), "pretokenizers")
    return (
        "Lowercase" in norms
        and set(norms) <= {"NFC", "Replace", "Lowercase"}
        and all(x == (r"\s+", " ") for x in blanks)
        and [p["type"] for p in pre] == ["Split", "ByteLevel"]
        and pre[0]["pattern"].get("Regex") == _SPLIT
        and pre[0]["behavior"] == "Removed"
        and bool(pre[0]["invert"])
        and not pre[1]["add_prefix_space"]
        and bool(rules["model"].get("end_of_word_suffix"))
    )


def byte_level(rules: dict) -> bool:
    """Does a tokenizer file split into bytes' words by the library's own pattern, without normalising or dropping anything?"""
    pre, model = rules.get("pre_tokenizer") or {}, rules["model"]
    return (
        rules.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre["add_prefix_space"]
        and pre.get("use_regex", True)
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in rules["added_tokens"])
    )


def encoder(path: str, offsets: bool) -> PieceEncoder | WholeEncoder:
    """This worker's encoder."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, offsets)
    if key not in _STORES:
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        kind = PieceEncoder if splits(rules) else BytePieceEncoder if byte_level(rules) and not offsets else WholeEncoder
        _STORES[key] = kind(path, offsets)
    return _STORES[key]


class WholeEncoder:
    """Every text as a whole, by the library."""

    def __init__(self, path: str, offsets: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.offsets = Tokenizer.from_file(path), offsets

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        clean = [(t or "").encode("utf-8", "replace").decode() for t in texts]
        found = (self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast)(clean, add_special_tokens=False)
        ids = np.array([i for x in found for i in x.ids], np.int32)
        n = np.array([len(x.ids) for x in found], np.int64)
        if not self.offsets:
            return ids, n, None, None
        spans = np.array([o for x in found for o in x.offsets], np.int32).reshape(-1, 2)
        return ids, n, spans[:, 0], spans[:, 1]


class PieceEncoder:
    def __init__(self, path: str, offsets: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.offsets = Tokenizer.from_file(path), offsets
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix")
        if not suffix:
            raise ValueError("the tokenizer must mark word ends")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.lo, self.hi = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _pieces(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        data, off = _text.joined(texts)
        cls = _CLASS[data]
        low = _text.LOWER[data]
        if (data >= 128).any():
            lead = np.flatnonzero(data[:-1] == 0xC3)
            next_ = data[lead + 1]
            letter = (next_ >= 0x80) & (next_ <= 0xBF) & (next_ != 0x97) & (next_ != 0xB7)
            lead, next_ = lead[letter], next_[letter]
            cls[lead] = cls[lead + 1] = 1
            capital = lead[next_ <= 0x9E] + 1
            low[capital] += 32
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        cls[special] = 4
        odd = cls == 4
        if odd.any():
            s, e = _text.word_ranges(data)
            total = np.concatenate([[0], np.cumsum(odd)])
            whole = total[e] > total[s]
            delta = np.zeros(len(data) + 1, np.int8)
            delta[s[whole]] += 1
            delta[e[whole]] -= 1
            inside = np.cumsum(delta[:-1]).astype(bool)
            cls[inside] = 4
        change = np.ones(len(data) + 1, bool)
        change[1:-1] = cls[1:] != cls[:-1]
        edge = np.flatnonzero(change)
        s, e = edge[:-1], edge[1:]
        real = cls[s] != 0
        s, e = s[real], e[real]
        kind = cls[s]
        h = _text.range_hashes(low, s, e)
        if (kind == 4).any():
            k = kind == 4
            h[k] = _text.mix(_text.range_hashes(data, s[k], e[k]) ^ _ODD)
        return data, off, s, e, kind, h

    def _learn(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, kind: np.ndarray, h: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "surrogatepass").encode("utf-8", "replace").decode() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        simple = np.flatnonzero((kind == 1) | (kind == 3)).tolist()
        alone = np.flatnonzero((kind != 1) & (kind != 3)).tolist()
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        order, ids, counts, spans = [], [], [], []
        for a in range(0, len(simple), 256):
            group = simple[a : a + 256]
            one = encode([" ".join([texts[i] for i in group])], add_special_tokens=False)[0]
            got = np.array(one.ids, np.int32)
            last = np.flatnonzero(self.ends[got]) + 1
            if len(last) != len(group) or last[-1] != len(got):
                alone += group
                continue
            n = np.diff(last, prepend=0)
            order += group
            ids.append(got)
            counts.append(n)
            if self.offsets:
                size = np.array([len(texts[i]) + 1 for i in group])
                spans.append(np.array(one.offsets, np.int32).reshape(-1, 2) - np.repeat(np.cumsum(size) - size, n)[:, None].astype(np.int32))
        for a in range(0, len(alone), 256):
            group = alone[a : a + 256]
            found = encode([texts[i] for i in group], add_special_tokens=False)
            order += group
            ids += [np.array(one.ids, np.int32) for one in found]
            counts.append(np.array([len(one.ids) for one in found], np.int64))
            if self.offsets:
                spans += [np.array(one.offsets, np.int32).reshape(-1, 2) for one in found]
        self._store(h[order], counts, ids, spans)

    def _store(self, h: np.ndarray, counts: list[np.ndarray], ids: list[np.ndarray], spans: list[np.ndarray]) -> None:
        """Keeps the ids of new pieces, by their hashes."""
        count = np.concatenate(counts).astype(np.int64)
        base = len(self.ids)
        self.start = np.concatenate([self.start, base + np.cumsum(count) - count])
        at = len(self.count) + np.arange(len(h))
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *ids])
        if self.offsets:
            self.lo = np.concatenate([self.lo, *(x[:, 0] for x in spans)])
            self.hi = np.concatenate([self.hi, *(x[:, 1] for x in spans)])
        # Only the new keys are sorted; they are merged with the others.
        by = np.argsort(h)
        to = np.searchsorted(self.keys, h[by])
        self.keys, self.at = np.insert(self.keys, to, h[by]), np.insert(self.at, to, at[by])

    def _look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        # Keys looked for in order are found several times faster.
        by = np.argsort(h)
        i = np.empty(len(h), np.int64)
        i[by] = np.minimum(np.searchsorted(self.keys, h[by]), len(self.keys) - 1)
        return self.at[i], self.keys[i] == h

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """All ids in order, how many each text has and, with offsets, the first and the end character of each id's token."""
        data, off, s, e, kind, h = self._pieces(texts)
        code, distinct = pd.factorize(h)
        if len(self.keys) + len(distinct) > MOST_KEPT:
            self.clear()
        at, known = self._look_up(distinct)
        if not known.all():
            new = np.flatnonzero(~known)
            first = np.zeros(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            f = first[new]
            self._learn(data, s[f], e[f], kind[f], distinct[new])
            at, _ = self._look_up(distinct)
        at = at[code]
        count = self.count[at]
        pick = _text.flat_ranges(self.start[at], count)
        total = np.concatenate([[0], np.cumsum(count)])
        per_text = np.diff(total[np.searchsorted(s, off)])
        if not self.offsets:
            return self.ids[pick], per_text, None, None
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        begins = char[s] - np.repeat(char[off[:-1]], np.diff(np.searchsorted(s, off)))
        base = np.repeat(begins, count)
        return self.ids[pick], per_text, self.lo[pick] + base, self.hi[pick] + base


_BYTE_CLASS = _CLASS.copy()
_WHITE, _LETTER, _ODD_CHUNK, _MARK = 0, 1, 4, 5  # the last: the newline that joins two texts


def _wide_blanks(data: np.ndarray) -> np.ndarray:
    """Places of white space that is not ASCII's, and of the control characters that some libraries count as such."""
    at = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    for lead, mid, last in ((0xC2, None, (0x85, 0xA0)), (0xE1, 0x9A, (0x80,)), (0xE1, 0xA0, (0x8E,)), (0xE2, 0x80, (*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, (0x9F,)), (0xE3, 0x80, (0x80,))):
        p = np.flatnonzero(data == lead)
        if mid is not None:
            p = p[data[p + 1] == mid] + 1  # a text ends with its newline, so there is a next byte
        at.append(p[np.isin(data[p + 1], last)])
    return np.concatenate(at)


class BytePieceEncoder(PieceEncoder):
    """For files of byte_level(): pieces are runs of letters, digits or signs with at most one space before them, and white space."""

    def __init__(self, path: str, offsets: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.offsets = Tokenizer.from_file(path), False
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        # A byte-level token has one character for each of its bytes.
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in rules["model"]["vocab"].items():
            self.size[i] = len(token)
        special = [re.escape(t["content"].encode()) for t in rules["added_tokens"]]
        self.special = re.compile(b"|".join(special)) if special else None
        self.clear()

    def _pieces(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        data, off = _text.joined(texts)
        cls = _BYTE_CLASS[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        cls[lead] = cls[lead + 1] = _LETTER
        cls[off[1:] - 1] = _MARK
        s, e = _text.word_ranges(data)
        total = np.concatenate([[0], np.cumsum(cls == _ODD_CHUNK)])
        whole = total[e] > total[s]
        cls[_text.flat_ranges(s[whole], (e - s)[whole])] = _ODD_CHUNK
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = cls[1:] != cls[:-1]
        # Of white space before something else, the last is a piece, or the space before that.
        last = np.flatnonzero((cls[:-1] == _WHITE) & (cls[1:] != _WHITE) & (cls[1:] != _MARK))
        edge[last] = True
        edge[last[data[last] == 0x20] + 1] = False
        odd = _wide_blanks(data)
        if self.special:
            odd = np.concatenate([odd, [m.start() for m in self.special.finditer(data.tobytes())]]).astype(np.int64)
        for k in np.unique(np.searchsorted(off, odd, "right") - 1):
            edge[off[k] + 1 : off[k + 1] - 1] = False
            cls[off[k] : off[k + 1] - 1] = _ODD_CHUNK
        at = np.flatnonzero(edge)
        s, e = at[:-1], at[1:]
        real = cls[s] != _MARK
        s, e = s[real], e[real]
        return data, off, s, e, cls[e - 1], _text.range_hashes(data, s, e)

    def _learn(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, kind: np.ndarray, h: np.ndarray) -> None:
        raw = data.tobytes()
        # Letters, digits and signs with a space before them stay apart when laid side by side: one call for many.
        run = (kind != _WHITE) & (kind != _ODD_CHUNK) & (data[s] == 0x20)
        ids, counts, order = [], [], []
        for group in np.array_split(np.flatnonzero(run), 1 + int(run.sum()) // 4096):
            if len(group):
                text = b"".join([raw[a:b] for a, b in zip(s[group].tolist(), e[group].tolist(), strict=True)])
                got = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.int32)
                ends = np.searchsorted(np.cumsum(self.size[got]), np.cumsum((e - s)[group])) + 1
                ids.append(got)
                counts.append(np.diff(ends, prepend=0))
                order.append(group)
        alone = np.flatnonzero(~run)
        texts = [raw[a:b].decode("utf-8", "surrogatepass").encode("utf-8", "replace").decode() for a, b in zip(s[alone].tolist(), e[alone].tolist(), strict=True)]
        for a in range(0, len(texts), 256):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[a : a + 256], add_special_tokens=False)]
            ids += [np.array(x, np.int32) for x in found]
            counts.append(np.array([len(x) for x in found], np.int64))
        self._store(h[np.concatenate([*order, alone])], counts, ids, [])
