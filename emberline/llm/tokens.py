"""Token ids of whole texts from the tokenizers library, with a bounded memo of pieces.

A byte-level BPE vocabulary never joins a word with what stands before its leading space, so a text may be
cut before any single space that stands between two visible characters. Pieces between such cuts are encoded
by the library once and then remembered; the memo is bounded and two-generational.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one thread

#: Characters after which a long text is next cut at a safe boundary.
CHUNK_CHARS = 1 << 20
#: Entries of one memo generation.
MEMO_ENTRIES = 500_000
#: Characters of the longest piece that is remembered beyond its batch, so that entries bound a memo's bytes too.
MEMO_CHARS = 64
#: Pieces that the library encodes in one text.
LEARN = 128


#: A word of Latin letters, with a full stop or comma or none, and perhaps the first word of the next line: each of
#: these parts, and the line break, is encoded alone whatever stands beside it.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?))?\\Z")
#: The signs that byte-level vocabularies write for bytes: printable Latin-1 for itself, the others from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = dict(zip([b for b in range(256) if b not in SHOWN], range(256, 512)))
SPACE, BLANKS = chr(BYTE_SIGNS[32]), tuple(chr(BYTE_SIGNS[b]) for b in b" \t\n\x0b\x0c\r")


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def _visible(c: str) -> bool:
    return c != " " and c.isprintable()


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Cut a long text only before a single space between two visible characters; the pieces join to the text."""
    start, n = 0, len(text)
    while n - start > size:
        at = text.find(" ", start + size)
        while at != -1 and not (at + 1 < n and _visible(text[at - 1]) and _visible(text[at + 1])):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def safe_pieces(parts: list[str], led: bool) -> Iterator[tuple[str, bool]]:
    """Join what ``text.split(" ")`` gave where a cut would not be safe: (piece without its leading space, has one)."""
    cur = parts[0]
    for p in parts[1:]:
        if cur and p and _visible(cur[-1]) and _visible(p[0]):
            yield cur, led
            cur, led = p, True
        else:
            cur = f"{cur} {p}"
    yield cur, led


class Memo(dict):
    """A dictionary with an older generation: what is found there moves back to the newer one.

    Pieces of over MEMO_CHARS characters, as of texts without spaces, are dropped at the next ``trim``: a generation
    holds at most ``entries`` short pieces and what one batch added.
    """

    def __init__(self, entries: int = MEMO_ENTRIES):
        self.entries, self.old, self.long = entries, {}, []

    def note(self, new) -> None:
        """Tell of the pieces about to be learned."""
        self.long += [p for p in new if len(p) > MEMO_CHARS]

    def promote(self, key):
        if (v := self.old.get(key)) is not None:
            self[key] = v
        return v

    def trim(self) -> None:
        for p in self.long:
            self.pop(p, None)
        self.long.clear()
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


class ByteBpe:
    """Ids of a byte-level BPE vocabulary (``byte_bpe_50k.json``), special strings as the library's default."""

    def __init__(self, path: str, memo: int = MEMO_ENTRIES):
        self.t = load(path)
        self.model = self.t.model.tokenize
        vocab = self.t.get_vocab(with_added_tokens=True)
        # of each id: whether it begins with a space, begins with white space, ends in a full stop, ! or ?
        self.starts, self.blanks, self.stops = (np.zeros(max(vocab.values()) + 1, bool) for _ in range(3))
        for s, i in vocab.items():
            self.starts[i], self.blanks[i], self.stops[i] = s.startswith(SPACE), s.startswith(BLANKS), s.endswith((".", "!", "?"))
        self.memo = Memo(memo)  # by the piece without its leading space
        self.ends = {c: x.tobytes() for c, x in zip(".,\n", self._ids([".", ",", "\n"]))}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode pieces that each follow a space and hold no other, many in one text."""
        for i in range(0, len(new), LEARN):
            some = new[i : i + LEARN]
            ids = self._ids([" " + " ".join(some)])[0]
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) == len(some) and cuts[0] == 0:
                raw, at = ids.tobytes(), 0
                for p, e in zip(some, [*(cuts[1:] * 4).tolist(), 4 * len(ids)]):
                    self.memo[p] = raw[at:e]
                    at = e
            else:
                for p, x in zip(some, self._ids([" " + p for p in some])):
                    self.memo[p] = x.tobytes()

    def _word(self, lead: str, word: str) -> bytes:
        """The ids of one word alone, from the library's model."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_SIGNS)
        return array("I", [t.id for t in self.model(lead + word)]).tobytes()

    def _meet(self, new: set[str]) -> None:
        """Put all of ``new`` that stand between safe cuts into the memo."""
        memo, match = self.memo, PLAIN.match
        memo.note(new)
        rest = []
        for p in new:
            if memo.promote(p) is not None:
                continue
            if m := match(p):
                word, end, line, line_end = m.groups()
                v = (memo.get(word) or memo.promote(word)) if end or line else None
                if v is None:
                    v = memo[word] = self._word(SPACE, word)
                    memo.note((word,))
                if end:
                    v += self.ends[end]
                if line:
                    v += self.ends["\n"] + self._word("", line)
                    if line_end:
                        v += self.ends[line_end]
                memo[p] = v
            elif p and _visible(p[0]) and _visible(p[-1]):
                rest.append(p)
        if rest:
            self._learn(rest)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text its ids as little-endian 32-bit numbers."""
        group: list[str] = []
        chars = 0
        for t in texts:
            if group and chars + len(t) > CHUNK_CHARS:
                yield from self._group(group)
                group, chars = [], 0
            if len(t) > CHUNK_CHARS:
                yield np.concatenate([ids for chunk in safe_chunks(t) for ids in self._group([chunk])])
                continue
            group.append(t)
            chars += len(t)
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        memo = self.memo
        memo.trim()
        flat: list[str] = []
        ends = []
        for t in texts:
            flat += t.split(" ")
            ends.append(len(flat))
        got = list(map(memo.get, flat))
        odd = []
        if miss := [i for i, v in enumerate(got) if v is None]:
            self._meet({flat[i] for i in miss})
            for i in miss:
                v = got[i] = memo.get(flat[i])
                if v is None:
                    odd.append(i)
        starts = [0, *ends[:-1]]
        firsts = self._ids([flat[a] for a in starts])
        # a text's first piece has no space before it and is always encoded here
        bad = set(np.searchsorted(ends, [i for i in odd], side="right").tolist()) if odd else ()
        for n, (a, b, first) in enumerate(zip(starts, ends, firsts)):
            # a led chunk begins with an empty piece
            if n in bad and None in got[a + 1 : b] or b - a > 1 and not (flat[a] and _visible(flat[a][-1])):
                yield np.frombuffer(b"".join(self._odd(flat[a:b])), "<u4")
            else:
                got[a] = first.tobytes()
                yield np.frombuffer(b"".join(got[a:b]), "<u4")

    def _odd(self, parts: list[str]) -> list[bytes]:
        led = not parts[0] and len(parts) > 1 and bool(parts[1]) and _visible(parts[1][0])
        pieces = list(safe_pieces(parts[1:], True) if led else safe_pieces(parts, False))
        plain = lambda p, s: s and " " not in p and p and _visible(p[0]) and _visible(p[-1])
        memo = self.memo
        if new := [p for p in dict.fromkeys(p for p, s in pieces if plain(p, s)) if memo.get(p) is None and memo.promote(p) is None]:
            memo.note(new)
            self._learn(new)
        rest = [(" " if s else "") + p for p, s in pieces if not plain(p, s)]
        ids = iter(self._ids(rest)) if rest else iter(())
        return [memo[p] if plain(p, s) else next(ids).tobytes() for p, s in pieces]


class WordCounter:
    """Token counts of a vocabulary whose tokens never hold white space (``word_bpe_49k.json``)."""

    MARK = "\x01"

    def __init__(self, path: str):
        self.t = load(path)
        if joined := [s for s in self.t.get_vocab(with_added_tokens=True) if any(c.isspace() for c in s)]:
            raise ValueError(f"tokens of this vocabulary hold white space, so texts can't be counted by words: {joined[0]!r}")
        if [e.ids for e in self.t.encode_batch(["a  b\nc", "a b c"], add_special_tokens=False)] != [self.t.encode(x, add_special_tokens=False).ids for x in ("a b c", "a\tb c")]:
            raise ValueError("white space changes this vocabulary's tokens, so texts can't be counted by words")
        mark = self.t.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.memo = Memo()

    def _learn(self, new: list[str]) -> None:
        easy = [p for p in new if self.MARK not in p] if self.mark is not None else []
        for i in range(0, len(easy), LEARN):
            some = easy[i : i + LEARN]
            text = f" {self.MARK} ".join(some)
            ids = np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(some) - 1:
                counts = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
                self.memo.update(zip(some, counts.tolist()))
        if left := [p for p in new if p not in self.memo]:
            for p, e in zip(left, self.t.encode_batch_fast(left, add_special_tokens=False)):
                self.memo[p] = len(e.ids)

    def _count(self, texts: list[str]) -> Iterator[int]:
        memo = self.memo
        memo.trim()
        flat: list[str] = []
        ends = []
        for t in texts:
            flat += t.replace("\n", " ").split(" ")
            ends.append(len(flat))
        got = list(map(memo.get, flat))
        if miss := [i for i, v in enumerate(got) if v is None]:
            if new := [p for p in {flat[i] for i in miss} if memo.promote(p) is None]:
                memo.note(new)
                self._learn(new)
            for i in miss:
                got[i] = memo[flat[i]]
        a = 0
        for b in ends:
            yield sum(got[a:b])
            a = b

    def counts(self, texts: list[str]) -> Iterator[int]:
        """The number of tokens of each text; groups hold about as many characters each, long texts stand alone."""
        group: list[str] = []
        chars = 0
        for t in texts:
            if chars + len(t) > CHUNK_CHARS and group:
                yield from self._count(group)
                group, chars = [], 0
            if len(t) > CHUNK_CHARS:
                yield sum(n for chunk in safe_chunks(t) for n in self._count([chunk]))
                continue
            group.append(t)
            chars += len(t)
        if group:
            yield from self._count(group)


_LOADED: dict[tuple, object] = {}


def shared(kind: type, path: str, *more):
    """One instance for each Python worker, so that the memo lasts from task to task."""
    if (kind, path, *more) not in _LOADED:
        _LOADED[kind, path, *more] = kind(path, *more)
    return _LOADED[kind, path, *more]
