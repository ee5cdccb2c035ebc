"""Token ids of whole texts with the tokenizers library, one call for each distinct word or part of a word.

The word tokenizer drops white space and never joins characters across it, so the ids of a text are
those of its words in order. Where the tokenizer is the one of STEPS, words of plain letters, digits and signs are
lower-cased and cut as its first steps do, so that the library is asked for the ids of far fewer pieces and only its
model works on them; all other words are its whole work. Each Python worker keeps the bytes and ids of pieces it has met in flat
arrays, found by hash and then compared byte by byte; beyond KEPT pieces it starts again, which costs time but
changes nothing. Pieces beyond words.LONG bytes, and those whose hash another one has, are not kept.
Where the tokenizer lower-cases, words of plain ASCII that differ by case only are one word.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from . import words

#: Pieces kept; pieces in one call of the tokenizer, calls at once; the word between whole words; bytes of text worked on at once.
KEPT, RUN, CALLS, MARK, CHUNK = 500_000, 512, 8, "|", 1 << 19
VOCABULARY = "word_bpe_49k.json"


#: Bytes of words that may be lower-cased before the tokenizer does it.
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.,;:!?'\"()-")] = True


def folds(tokenizer) -> bool:
    """Whether words of plain bytes have the ids of their lower case: nothing before the tokenizer's lower-casing tells cases
    apart, and no added token, which is looked for in the text as it is, is made of plain bytes alone."""
    known = json.loads(tokenizer.to_str())
    step = known.get("normalizer") or {}
    for step in step["normalizers"] if step.get("type") == "Sequence" else [step]:
        if step.get("type") == "Lowercase":
            return not any(_PLAIN[list(t["content"].encode())].all() for t in known.get("added_tokens") or ())
        if step.get("type") not in ("NFC", "NFD", "NFKC", "NFKD") and step.get("pattern") != {"Regex": "\\s+"}:
            return False
    return False


#: What a tokenizer does before its model where `cuts` may do it: the pattern's contractions are the only rule about what stands around a character.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}
WORD_END = "</w>"
#: Kinds of bytes: white space, letters, digits, signs, and those that keep a word whole ("'" begins contractions, "<" and "|" added tokens).
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[0x21:0x7F] = SIGN
_KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]], _KIND[0x30:0x3A], _KIND[list(b"'<|")] = LETTER, DIGIT, ODD


def cuts(tokenizer) -> bool:
    """Whether words without an odd character may be lower-cased and cut here: the tokenizer's steps are the known ones, its model
    marks the end of each part, and every added token holds an odd character."""
    known = json.loads(tokenizer.to_str())
    model = known["model"]
    return (
        all(known.get(k) == step for k, step in STEPS.items())
        and (model["type"], model.get("end_of_word_suffix")) == ("BPE", WORD_END)
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix"))
        and all(t["content"].isascii() and (_KIND[list(t["content"].encode())] == ODD).any() for t in known.get("added_tokens") or ())
    )


class Cut(str):
    """Parts of plain words with blanks between them."""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.folds = folds(self.tokenizer)
        self.cuts = self.folds and cuts(self.tokenizer)
        if self.cuts:
            self.model = Tokenizer(self.tokenizer.model)  # the same model, not a copy
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a part
            self.last[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        # of each piece: its hash, where its ids begin in `pool` and how many they are, where its bytes begin in `spelt` and how many
        self.keys, self.facts = np.zeros(1 << 15, np.uint64), np.zeros((1 << 15, 4), np.int32)
        self.table = np.full(1 << 17, -1, np.int32)  # pieces by hash; a taken place sends on to the next
        self.pool, self.used = np.zeros(1 << 17, np.uint32), 0
        self.spelt, self.spelt_used = np.zeros(1 << 18, np.uint8), 0

    def _called(self, texts: list[str]):
        """The tokenizer's ids of each text; what it returns besides is held for CALLS texts at once only."""
        by = self.model if texts and isinstance(texts[0], Cut) else self.tokenizer
        for at in range(0, len(texts), CALLS):
            for e in by.encode_batch_fast(texts[at : at + CALLS], add_special_tokens=False):
                yield np.array(e.ids, np.uint32)

    def _ids(self, texts: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other (placed at the pool's end, not kept yet), and their numbers. Plain ones are cut already."""
        size, parts, done = np.zeros(len(texts), np.int64), {}, np.zeros(len(texts), bool)
        known = np.flatnonzero(plain).tolist()
        cut = [known[i : i + RUN] for i in range(0, len(known), RUN)]
        for run, ids in zip(cut, self._called([Cut(b" ".join([texts[i] for i in run]).decode()) for run in cut])):
            end = np.flatnonzero(self.last[ids])
            if len(end) == len(run):
                size[run], done[run] = np.diff(end, prepend=-1), True
                parts[run[0]] = ids  # a run's ids stand at its first piece
        # Many words a call, with a mark of one id between them that none of them holds; words with the mark go alone.
        spelt = {i: texts[i].decode("utf-8", "replace") for i in np.flatnonzero(~done).tolist()}
        together = [i for i, w in spelt.items() if MARK not in w] if self.mark is not None else []
        runs = [together[i : i + RUN] for i in range(0, len(together), RUN)]
        for run, ids in zip(runs, self._called([f" {MARK} ".join(spelt[i] for i in run) for run in runs])):
            end = np.flatnonzero(ids == self.mark)
            if len(end) == len(run) - 1:
                size[run], done[run] = np.diff(np.concatenate([[-1], end, [len(ids)]])) - 1, True
                parts[run[0]] = np.delete(ids, end)
        rest = np.flatnonzero(~done).tolist()
        for i, ids in zip(rest, self._called([spelt[i] for i in rest])):
            parts[i], size[i] = ids, len(ids)
        kept = [run for run in cut + runs if run[0] in parts and done[run[0]]]
        order = np.array([i for run in kept for i in run] + rest, np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *(parts[run[0]] for run in kept), *(parts[i] for i in rest)])
        self.pool = _room(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        first = np.zeros(len(texts), np.int64)
        first[order] = self.used + np.cumsum(size[order]) - size[order]
        return first, size

    def _row(self, keys: np.ndarray) -> np.ndarray:
        """The piece that has this hash, -1 if none."""
        mask = np.uint64(len(self.table) - 1)
        at = (keys & mask).astype(np.int64)
        row = self.table[at]
        left = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.table) - 1)
            row[left] = self.table[at[left]]
            left = left[(row[left] >= 0) & (self.keys[row[left]] != keys[left])]
        return row

    def _place(self, rows: np.ndarray) -> None:
        """Enter these pieces, whose hashes differ, into the table."""
        at = (self.keys[rows] & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(rows):
            free = self.table[at] < 0
            self.table[at[free]] = rows[free]
            left = self.table[at] != rows
            rows, at = rows[left], (at[left] + 1) & (len(self.table) - 1)

    def _learn(self, keys: np.ndarray, texts: list[bytes], plain: np.ndarray) -> None:
        first, size = self._ids(texts, plain)
        self.used += int(size.sum())
        raw, lengths = np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
        count = self.count + len(texts)
        self.spelt = _room(self.spelt, self.spelt_used + len(raw) + 8)
        self.spelt[self.spelt_used : self.spelt_used + len(raw)] = raw
        self.keys, self.facts = _room(self.keys, count), _room(self.facts, count)
        self.keys[self.count : count] = keys
        self.facts[self.count : count] = np.stack([first, size, self.spelt_used + np.cumsum(lengths) - lengths, lengths], 1)
        self.spelt_used += len(raw)
        if 2 * count > len(self.table):
            self.table = np.full(1 << (4 * count).bit_length(), -1, np.int32)
            self._place(np.arange(count, dtype=np.int32))
        else:
            self._place(np.arange(self.count, count, dtype=np.int32))
        self.count = count

    def _find(self, keys: np.ndarray, window: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The known piece with the same hash and bytes, -1 if none."""
        row = self._row(keys)
        spelt, place = np.ndarray((len(self.spelt) - 7,), "<u8", self.spelt, strides=(1,)), self.facts[row, 2]
        same = (row >= 0) & (self.facts[row, 3] == size)
        known = np.flatnonzero(same)
        same[known] = words.equal(window, at[known], spelt, place[known], size[known])
        row[~same] = -1
        return row

    @staticmethod
    def _folded(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes with words of plain bytes in lower case."""
        odd = np.append(0, np.cumsum(~_PLAIN[part]))
        kept = odd[ends] > odd[starts]
        inside = np.zeros(len(part) + 1, np.int8)
        inside[starts[kept]] += 1
        inside[ends[kept]] -= 1
        return np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, part, words.lower(part))

    @staticmethod
    def _cut(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes in lower case, start and end of each part of a plain word and of each word with an odd byte, and which are plain."""
        kind, begin, stop = _KIND[part], np.zeros(len(part), bool), np.zeros(len(part), bool)
        begin[starts], stop[ends - 1] = True, True
        # the letters of U+00C0 to U+00FF, in two bytes; U+00D7 and U+00F7 are signs
        lead = np.flatnonzero(part[:-1] == 0xC3)
        trail = part[lead + 1]
        letter = (trail >= 0x80) & (trail <= 0xBF) & (trail != 0x97) & (trail != 0xB7) & ~begin[lead + 1]
        lead, trail = lead[letter], trail[letter]
        kind[lead], kind[lead + 1] = LETTER, LETTER
        low = words.lower(part)
        low[lead[trail < 0x9F] + 1] += 0x20
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            word = np.unique(np.searchsorted(starts, odd, "right") - 1)
            size = ends[word] - starts[word]
            before = np.cumsum(size) - size
            inside = np.arange(before[-1] + size[-1]) + np.repeat(starts[word] - before, size)
            kind[inside] = ODD
            cased = inside[np.repeat(np.logical_or.reduceat(~_PLAIN[part[inside]], before), size)]
            low[cased] = part[cased]
        begin[1:] |= ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & (kind[1:] != BLANK)
        stop[:-1] |= begin[1:] & (kind[:-1] != BLANK)
        at = np.flatnonzero(begin)
        return low, at, np.flatnonzero(stop) + 1, kind[at] != ODD

    def encode(self, column: pa.Array):
        """For each range of texts: its number of texts, their ids in a row, each text's number of ids."""
        data, offsets = words.text_buffer(column)
        for lo, hi in words.chunks(offsets, CHUNK):
            own = offsets[lo : hi + 1]
            part, own = data[own[0] : own[-1]], own - own[0]
            starts, ends, first = words.segment(part, own)
            if not len(starts):
                yield hi - lo, np.zeros(0, np.uint32), np.zeros(hi - lo, np.int64)
                continue
            if self.cuts:
                part, starts, ends, plain = self._cut(part, starts, ends)
                first = np.searchsorted(starts, own)
            else:
                part, plain = self._folded(part, starts, ends) if self.folds else part, np.zeros(len(starts), bool)
            length, raw, window = ends - starts, memoryview(part), words.windows(part)
            keys = words.hashes(part, starts, ends)
            if self.count > KEPT:
                self._clear()
            row = self._find(keys, window, starts, length)
            begin, size = self.facts[row, 0].astype(np.int64), self.facts[row, 1].astype(np.int64)
            new = np.flatnonzero(row < 0)
            if len(new):
                number: dict[bytes, int] = {}
                of = np.array([number.setdefault(bytes(raw[s:e]), len(number)) for s, e in zip(starts[new].tolist(), ends[new].tolist())], np.int64)
                texts, at = list(number), new[np.unique(of, return_index=True)[1]]
                # The first piece of each hash is kept; those that differ from it, or are long, go by themselves.
                keep = np.zeros(len(texts), bool)
                keep[np.unique(keys[at], return_index=True)[1]] = True
                keep &= (length[at] <= words.LONG) & (self._row(keys[at]) < 0)
                found = np.zeros((len(texts), 2), np.int64)
                kept, alone = np.flatnonzero(keep), np.flatnonzero(~keep)
                if len(kept):
                    before = self.count
                    self._learn(keys[at[kept]], [texts[i] for i in kept.tolist()], plain[at[kept]])
                    found[kept] = self.facts[before : self.count, :2]
                if len(alone):
                    found[alone] = np.stack(self._ids([texts[i] for i in alone.tolist()], plain[at[alone]]), 1)
                begin[new], size[new] = found[of, 0], found[of, 1]
            total = np.append(0, np.cumsum(size))
            ids = self.pool[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
            yield hi - lo, ids, np.diff(total[first])


def _room(kept: np.ndarray, rows: int) -> np.ndarray:
    """The array with room for so many rows; new room takes memory only as it is written to."""
    if rows <= len(kept):
        return kept
    out = np.zeros((1 << rows.bit_length(), *kept.shape[1:]), kept.dtype)
    out[: len(kept)] = kept
    return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this vocabulary file; it stays for later tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str):
    """For each text of the column: its ids."""
    for _, ids, sizes in encoder(path).encode(column):
        at = np.append(0, np.cumsum(sizes))
        for i in range(len(sizes)):
            yield ids[at[i] : at[i + 1]]
