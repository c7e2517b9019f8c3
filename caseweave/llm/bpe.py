"""Token ids by a public tokenizer file, with every distinct piece encoded once.

Neither the normaliser nor the pre-tokenizer of such a file looks across white space, so a text's ids are its
words' ids one after another. Words of ASCII and Latin-1 letters and ASCII punctuation are cut further into
runs of letters (in lower case), runs of punctuation and single digits, as the pre-tokenizer does; any other
word goes to the tokenizer whole. A memory of bounded size keeps the pieces met before.
"""

from __future__ import annotations

import gc
import os

import numpy as np

from caseweave.llm.common import same_words, slices, utf8, word_hashes, word_spans

MARK = "\x01"
#: Classes of bytes: 1 letter, 2 punctuation, 3 digit, 4 white space, 0 else. The apostrophe starts contractions and the bar special tokens, so they are "else".
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), 123, 125, 126]] = 2
CLASS[39] = 0
CLASS[48:58] = 3
CLASS[[*range(65, 91), *range(97, 123)]] = 1
CLASS[[32, *range(9, 14)]] = 4
#: ASCII in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Memory:
    """A dictionary of at most twice `most` entries: when the young half is full it becomes the old one, and what is met again is young again."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, keys: list, ask) -> list:
        """The values of keys; ask(list) gives those not known."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, keys))
        fresh = [k for k, v in enumerate(found) if v is None]
        if self.old:
            for k in fresh:
                found[k] = self.old.get(keys[k])
            self.young.update([(keys[k], found[k]) for k in fresh if found[k] is not None])
            fresh = [k for k in fresh if found[k] is None]
        if fresh:
            new = [keys[k] for k in fresh]
            values = ask(new)
            self.young.update(zip(new, values, strict=True))
            for k, v in zip(fresh, values, strict=True):
                found[k] = v
        return found


class WordEncoder:
    """The ids that the tokenizer itself gives for whole texts, without special tokens."""

    def __init__(self, path: str, ordinary: bool = False, most_pieces: int = 300_000):
        """`ordinary`: the strings of special tokens in a text are ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        #: Whether the parts give the same ids as the whole here, and case doesn't count.
        self.parts = self._plain("Été,12") == b"".join(map(self._plain, ("été", ",", "1", "2"))) and self._plain("A") == self._plain("a")
        self.pieces = Memory(most_pieces)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)  # the ids that end a piece
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix and self.parts:
            self.closing[[k for w, k in vocabulary.items() if w.endswith(suffix)]] = True

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts laid end to end as UTF-8 (text i is data[offsets[i]:offsets[i + 1]]), and where each text's ids begin and end."""
        starts, ends, first = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        if self.parts:
            data, starts, ends, first = cut(data, starts, ends, first)
        _, example, which = np.unique(word_hashes(data, starts, ends)[0], return_index=True, return_inverse=True)
        other = np.flatnonzero(~same_words(data, starts, ends, example[which]))  # pieces of one hash that are not the same stand for themselves
        which[other] = len(example) + np.arange(len(other))
        example = np.append(example, other)
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        gc.disable()  # nothing here makes cycles, and the many small objects would be searched again and again
        try:
            found = self.pieces.get(pieces, self._ask)
        finally:
            gc.enable()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        each = sizes[which]
        at = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=at[1:])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - at[:-1], each) + np.arange(at[-1])]
        return ids, at[first]

    def _ask(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece. Many are encoded in one text and told apart by the ids that end a piece, or by a mark between them."""
        words = [p.decode("utf-8", "replace") for p in pieces]
        out: list[bytes | None] = [None] * len(words)
        simple = [k for k, w in enumerate(words) if w.isalpha() and w.islower() and max(w) < "\u0100"] if self.closing.any() else []
        self._together(words, simple, " ", lambda ids: np.flatnonzero(self.closing[ids]) + 1, out)
        if self.mark is not None:
            plain = [k for k, w in enumerate(words) if out[k] is None and MARK not in w]
            self._together(words, plain, f" {MARK} ", lambda ids: np.append(np.flatnonzero(ids == self.mark), len(ids)), out, 1)
        return [self._plain(words[k]) if x is None else x for k, x in enumerate(out)]

    def _together(self, words: list[str], chosen: list[int], mark: str, ends_of, out: list, skip: int = 0) -> None:
        groups = [chosen[i : i + 256] for i in range(0, len(chosen), 256)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([mark.join([words[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends = ends_of(ids)
            if len(ends) == len(group):
                raw, a = ids.tobytes(), 0
                for k, end in zip(group, (ends * 4).tolist(), strict=True):
                    out[k] = raw[a:end]
                    a = end + 4 * skip


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """Cut words of known bytes into pieces, in lower case; the others stay whole. `first`: the first word of each text, then the first piece."""
    kind, lower = CLASS[data], LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    follow = data[lead + 1]
    good = (follow != 0x97) & (follow != 0xB7)
    lead, follow = lead[good], follow[good]
    kind[lead] = kind[lead + 1] = 1
    lower[lead + 1] = np.where(follow <= 0x9E, follow + 32, follow)
    change = np.empty(len(data), bool)
    change[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= kind == 3
    change &= kind != 4
    odd = np.flatnonzero(kind == 0)
    if len(odd):
        odd = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        size = ends[odd] - starts[odd]
        inside = np.arange(size.sum()) + np.repeat(starts[odd] - (np.cumsum(size) - size), size)
        change[inside] = False
        lower[inside] = data[inside]
    change[starts] = True
    begins = np.flatnonzero(change)
    change[:] = False
    change[starts] = True
    word = np.flatnonzero(change[begins])
    last = np.append(begins[1:], len(data))
    last[np.append(word[1:], len(begins)) - 1] = ends
    return lower, begins, last, np.append(word, len(begins))[first]


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, ordinary: bool = False) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if (path, ordinary) not in _encoders:
        _encoders[path, ordinary] = WordEncoder(path, ordinary)
    return _encoders[path, ordinary]


def encoded(batches, path: str, ordinary: bool = False, most: int = 3 << 19):
    """(batch, first row, ids, offsets of each row's ids) over Arrow batches whose column "text" holds the texts, about `most` bytes at a time."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets, most):
            yield batch, a, *encoder(path, ordinary).encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def id_type(path: str) -> str:
    """The narrowest little-endian type for the ids of a tokenizer file."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
