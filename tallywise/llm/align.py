"""Alignment of the tokens of two tokenizers over the bytes of each text.

Both tokenizers read the same bytes, a space and the text. Offsets at which tokens of both end cut a text into
groups; two tokens are linked if their byte ranges overlap. Fragments of a text form a monoid: the tokens of any
byte range are an open beginning, closed groups and an open end, and two neighbours are put together by looking
at the open parts between them alone. Texts longer than a piece are cut into byte ranges which different tasks
tokenize, and a tree of compositions puts them together; a short text is a single fragment.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywise.llm.common import answer, ask, ask_buckets, mix, pack, pieces, ragged, unpack, with_answers

#: Bits of the second id in the code of a pair of ids.
LOW_BITS = 24
#: Segments whose tokens a Python worker remembers.
REMEMBERED = 150_000
#: Pieces that one composition of the tree puts together.
FAN_IN = 8


# ---------------------------------------------------------------- tokenizers

#: Fixed value: how byte-level vocabularies split a text before they merge.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class ByteLevelBpe:
    """The JSON text of a byte-level BPE of the tokenizers library, which splits words off with the space before
    them, and its number of ids. Strings of special tokens in a text are plain text."""
    model: str
    size: int
    #: It splits a text by kinds of characters before it merges.
    by_words: bool = True

    def load(self) -> tuple:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.model)
        t.encode_special_tokens = True
        shown = _shown_bytes()
        table = {i: bytes(shown[c] for c in p) if all(c in shown for c in p) else p.encode()
                 for p, i in t.get_vocab(with_added_tokens=True).items()}
        special = {i for i, token in t.get_added_tokens_decoder().items() if token.special}
        # The same merges, several times as fast. Both agree on what a letter is where scripts are long settled.
        fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_SPLIT, special_tokens={},
                                 mergeable_ranks={b: i for i, b in table.items() if i not in special})

        def encode(segments: list[bytes]) -> list:
            texts = [s.decode() for s in segments]
            latin = [t.isascii() or max(t) < "\u0250" for t in texts]
            one = fast.encode_ordinary
            out = [one(t) if quick else None for t, quick in zip(texts, latin)]
            other = [i for i, quick in enumerate(latin) if not quick]
            for i, e in zip(other, t.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)):
                out[i] = e.ids
            return out

        return encode, table


@dataclass(frozen=True)
class PieceBpe:
    """The file of a sentencepiece BPE that adds a space, keeps all white space, and has no piece with a space
    after another character; and its number of ids."""
    model: bytes
    size: int
    by_words: bool = False

    def load(self) -> tuple:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        table = {}
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            table[i] = bytes([int(piece[3:5], 16)]) if p.is_byte(i) else piece.replace("▁", " ").encode()
        # A segment begins with the space that this tokenizer adds.
        return (lambda segments: p.encode([s[1:].decode() for s in segments], num_threads=1)), table


def _shown_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies show bytes: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Encoder:
    """Ids of segments, each distinct one encoded once as long as it is remembered."""

    def __init__(self, tokenizer):
        self.encode, table = tokenizer.load()
        self.bytes = pa.array([table.get(i, b"") for i in range(tokenizer.size)], pa.large_binary())
        self.length = pc.binary_length(self.bytes).to_numpy(zero_copy_only=False).astype(np.int64)
        #: A segment's ids as 32-bit numbers; None where their bytes are not the segment's.
        self.known: dict[bytes, bytes | None] = {}

    def _learn(self, segments: list[bytes]) -> None:
        found = self.encode(segments)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        self.known.update(zip(segments, (raw[a:b] for a, b in zip([0, *ends], ends))))
        said, whole = self.bytes.take(pa.array(ids)), b"".join(segments)
        length = np.add.reduceat(np.append(self.length[ids], 0), np.cumsum(sizes) - sizes) * (sizes > 0)
        if (length == np.fromiter(map(len, segments), np.int64, len(segments))).all() and said.buffers()[2] is not None \
                and said.buffers()[2].to_pybytes()[:len(whole)] == whole:
            return
        each = self.bytes.to_pylist()
        for s, x in zip(segments, found):
            if b"".join([each[i] for i in x]) != s:
                self.known[s] = None

    def ids(self, segments: list[bytes]) -> list:
        """The ids of each segment, as bytes."""
        known = self.known
        new = [s for s in segments if s not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = segments
        for part in range(0, len(new), 20_000):
            self._learn(new[part:part + 20_000])
        return [known[s] for s in segments]

    def tokens(self, data: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids`` of the segments of ``data`` that begin at ``starts``, how many each has, and which ones fit."""
        ends = np.append(starts, end).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        found = self.ids(coded.dictionary.to_pylist())
        fits = np.fromiter((x is not None for x in found), bool, len(found))
        if not fits.all():
            found = [x or b"" for x in found]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        n = sizes[codes]
        return flat[ragged((np.cumsum(sizes) - sizes)[codes], n)], n, fits[codes]


_loaded: dict = {}


def _aligner(first, second) -> _Aligner:
    """One for a pair of tokenizers and a worker process."""
    if (first, second) not in _loaded:
        _loaded.clear()
        _loaded[first, second] = _Aligner(first, second)
    return _loaded[first, second]


def cuts(data: np.ndarray, words: bool) -> np.ndarray:
    """Offsets over which no token goes, so that what lies between two of them is encoded by itself.

    Those are spaces between two characters that are no white space; for ``words``, which splits a text by kinds
    of characters, line breaks between such characters too, and the marks after a plain letter. A character that
    may begin white space counts as such on the right side of a cut.
    """
    at = np.flatnonzero((data == 32) | (data == 10) if words else data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    x, after = data[at - 1], data[at + 1]
    y, z = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = ((y == 0xC2) & ((x == 0x85) | (x == 0xA0))
            | (z == 0xE1) & ((y == 0x9A) & (x == 0x80) | (y == 0xA0) & (x == 0x8E))
            | (z == 0xE2) & ((y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF))
                             | (y == 0x81) & (x == 0x9F))
            | (z == 0xE3) & (y == 0x80) & (x == 0x80))
    may_begin = (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
    at = at[(x > 32) & ~wide & (after > 32) & ~may_begin]
    if not words:
        return at
    mark = np.flatnonzero(_MARKS[data[1:]] & _PLAIN_LETTERS[data[:-1]]) + 1
    return np.sort(np.concatenate((at, mark)))


_MARKS, _PLAIN_LETTERS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (
    b",.;:!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


# ---------------------------------------------------------------- fragments

@dataclass
class Tokens:
    """Ids and end offsets of both tokenizers' tokens in a byte range."""
    a: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    a_end: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    b: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    b_end: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self.parts(), other.parts())))

    def parts(self) -> tuple:
        return self.a, self.a_end, self.b, self.b_end

    def cut(self, a_from, a_to, b_from, b_to) -> Tokens:
        return Tokens(self.a[a_from:a_to], self.a_end[a_from:a_to], self.b[b_from:b_to], self.b_end[b_from:b_to])

    def marks(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The least offset, and which offsets from it on are ends of tokens of each kind."""
        ends = [e for e in (self.a_end, self.b_end) if len(e)]
        low = min((int(e[0]) for e in ends), default=0)
        out = np.zeros((2, max((int(e[-1]) for e in ends), default=low) - low + 1), bool)
        out[0][self.a_end - low] = True
        out[1][self.b_end - low] = True
        return low, out[0], out[1]

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``a`` and in ``b`` of the tokens that end together."""
        _, a, b = self.marks()
        both = np.flatnonzero(a & b)
        return np.cumsum(a, dtype=np.int32)[both] - 1, np.cumsum(b, dtype=np.int32)[both] - 1


class Written:
    """The decimal ids of both vocabularies with what follows each: ``,`` in a list, ``|`` after the last token of
    the first tokenizer, ``;`` after a group."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        parts = []
        for n, after in ((n_a, ",|"), (n_b, ",;")):
            each = pa.array(np.repeat(np.arange(n), 2)).cast(pa.string())
            parts.append(pc.binary_join_element_wise(each, pa.array(list(after) * n), "").cast(pa.large_binary()))
        self.table = pa.concat_arrays(parts)

    def groups(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens that end at a group's end: the groups' text, each group's end in it and its end in bytes."""
        if not len(t.a):
            return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
        last_a, last_b = t.common()
        a_ends, b_ends = last_a + 1, last_b + 1
        in_a, in_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        group_a, group_b = np.repeat(np.arange(len(in_a)), in_a), np.repeat(np.arange(len(in_b)), in_b)
        at_a = np.arange(len(t.a)) + (b_ends - in_b)[group_a]
        at_b = np.arange(len(t.b)) + a_ends[group_b]
        which = np.empty(len(t.a) + len(t.b), np.int64)
        which[at_a], which[at_b] = 2 * t.a.astype(np.int64), 2 * (self.n_a + t.b.astype(np.int64))
        which[at_a[last_a]] += 1
        which[at_b[last_b]] += 1
        text = self.table.take(pa.array(which))
        ends = np.frombuffer(text.buffers()[1], np.int64)[:len(which) + 1]
        return np.frombuffer(text.buffers()[2] or b"", np.uint8), ends[at_b[last_b] + 1], t.a_end[last_a]


def links(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The pair code of each link, and the offset at which the shared bytes end.

    Between two neighbouring ends lies one token of each tokenizer, and two tokens share one such stretch at most.
    """
    low, a, b = t.marks()
    ends = np.flatnonzero(a | b) if len(t.a) else np.empty(0, np.int64)
    # The token that covers what lies before an end is the first one that ends there or later.
    in_a, in_b = ((np.cumsum(m, dtype=np.int32) - m)[ends] for m in (a, b))
    return (t.a[in_a].astype(np.int64) << LOW_BITS) | t.b[in_b], ends + low


def distinct_of(x: np.ndarray) -> np.ndarray:
    """Distinct numbers in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def tally(codes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and how often each occurs."""
    if times is None:
        return np.unique(codes, return_counts=True)
    distinct, where = np.unique(codes, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, where, times)
    return distinct, total


@dataclass
class Fragment:
    """The tokens of a byte range of one text.

    Without a common end (``bounded`` false) all tokens are in ``head``. Else ``head`` goes to the first common
    end, ``tail`` begins after the last one, and the groups between are closed: their text, token counts and the
    tally of their links. ``fits`` says that the tokens' bytes are the text's.
    """
    head: Tokens
    bounded: bool = False
    tail: Tokens = field(default_factory=Tokens)
    text: list = field(default_factory=list)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    codes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    fits: bool = True

    def state(self) -> tuple:
        """Plain values, for ``Fragment.back``."""
        return (self.head.parts(), self.bounded, self.tail.parts(), self.text, self.n_a, self.n_b, self.n_groups,
                self.codes, self.times, self.fits)

    @classmethod
    def back(cls, state: tuple) -> Fragment:
        return cls(Tokens(*state[0]), state[1], Tokens(*state[2]), *state[3:])

    @classmethod
    def of(cls, t: Tokens, written: Written, fits: bool = True) -> Fragment:
        last_a, last_b = t.common()
        if not len(last_a):
            return cls(t, fits=fits)
        head = t.cut(0, last_a[0] + 1, 0, last_b[0] + 1)
        tail = t.cut(last_a[-1] + 1, None, last_b[-1] + 1, None)
        return cls(head, True, tail, fits=fits)._closing(
            t.cut(last_a[0] + 1, last_a[-1] + 1, last_b[0] + 1, last_b[-1] + 1), written)

    def _closing(self, t: Tokens, written: Written) -> Fragment:
        """This fragment with the whole groups of ``t`` after its closed ones."""
        if not len(t.a):
            return self
        text, ends, _ = written.groups(t)
        codes, times = tally(links(t)[0])
        self.text = [*self.text, text.tobytes()]
        self.codes, self.times = tally(np.concatenate((self.codes, codes)), np.concatenate((self.times, times)))
        self.n_a, self.n_b, self.n_groups = self.n_a + len(t.a), self.n_b + len(t.b), self.n_groups + len(ends)
        return self

    def then(self, other: Fragment, written: Written) -> Fragment:
        """The fragment of both ranges; associative, and the same as that of all tokens at once."""
        if not (self.fits and other.fits):
            return Fragment(Tokens(), fits=False)
        between = Fragment.of((self.tail if self.bounded else self.head) + other.head, written)
        if not self.bounded and not other.bounded:
            return between
        parts = [self] * self.bounded
        if between.bounded:
            if self.bounded:  # the first group between is whole, as it begins at a common end
                parts.append(Fragment(Tokens(), True)._closing(between.head, written))
            parts.append(between)
        parts += [other] * other.bounded
        tail = other.tail if other.bounded else between.tail if between.bounded else between.head
        out = Fragment(self.head if self.bounded else between.head, True, tail, [x for p in parts for x in p.text])
        out.codes, out.times = tally(np.concatenate([p.codes for p in parts]), np.concatenate([p.times for p in parts]))
        out.n_a, out.n_b, out.n_groups = (sum(getattr(p, k) for p in parts) for k in ("n_a", "n_b", "n_groups"))
        return out

    def finished(self, written: Written) -> Fragment:
        """As that of a whole text, which begins and ends at a common end: everything closed."""
        if not self.fits:
            return Fragment(Tokens(), True)
        first = Fragment(Tokens(), True)._closing(self.head, written)
        return first.then(Fragment(Tokens(), True, text=self.text, n_a=self.n_a, n_b=self.n_b,
                                   n_groups=self.n_groups, codes=self.codes, times=self.times), written)


# ---------------------------------------------------------------- texts to aligned chunks

def _spaced(text: pa.Array) -> pa.Array:
    """Each text after a space, as bytes; a null or empty text has none."""
    text = pc.fill_null(text, "")
    made = pc.binary_join_element_wise(pa.scalar("", text.type), text, pa.scalar(" ", text.type))
    return pc.if_else(pc.equal(pc.binary_length(text), 0), pa.scalar("", made.type), made).cast(pa.large_binary())


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; one more for the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return np.ascontiguousarray(data), offsets - offsets[0]


def _narrow(x: np.ndarray) -> list:
    """The bytes of numbers in planes, which press well."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or x.max() < 1 << (8 * w))
    return [width, x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()]


def _wide(x: list) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x[1], np.uint8).reshape(x[0], -1).T).view(f"<u{x[0]}").ravel().astype(np.int64)


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and each code's number among them."""
    values = pa.array(codes).dictionary_encode()
    return values.dictionary.to_numpy(), values.indices.to_numpy().astype(np.int64)


def _chunk(doc_ids: pa.Array, counts: np.ndarray, text: bytes, text_ends: np.ndarray, doc: np.ndarray,
           distinct: np.ndarray, number: np.ndarray, times: np.ndarray) -> bytes:
    """Aligned documents: counts (tokens of each kind and groups), groups as text, and per document its pairs.

    ``doc``, ``number`` (of the pair among ``distinct``) and ``times`` are in order of document. A pair is kept
    as its place among the chunk's pairs, the frequent ones first.
    """
    often = np.bincount(number, minlength=len(distinct))
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    again = np.argsort(doc * max(1, len(order)) + rank[number], kind="stable")
    doc, pair, times = doc[again], rank[number][again], times[again]
    first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.empty(0, bool)
    steps = np.where(first, pair, np.diff(pair, prepend=0)) if len(doc) else pair
    return pack((doc_ids, counts, text, text_ends, distinct[order], often[order],
                 _narrow(np.bincount(doc, minlength=len(counts))), _narrow(steps), _narrow(times)))


def _pairs(payload: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back from ``_chunk``: pairs of each document, their numbers among the chunk's pairs, how often each occurs."""
    n, steps, times = (_wide(x) for x in payload[6:9])
    total = np.cumsum(steps)
    first = np.cumsum(n) - n
    before = np.where(n > 0, total[np.minimum(first, max(0, len(total) - 1))]
                      - steps[np.minimum(first, max(0, len(steps) - 1))] if len(total) else 0, 0)
    return n, total - np.repeat(before, n), times


class _Aligner:
    """What a worker needs to align texts with two tokenizers."""

    def __init__(self, first, second):
        self.kinds = first, second
        self.written = Written(first.size, second.size)

    @cached_property
    def encoders(self) -> tuple[_Encoder, _Encoder]:
        return _Encoder(self.kinds[0]), _Encoder(self.kinds[1])

    def documents(self, doc_ids: pa.Array, texts: pa.Array) -> bytes:
        """An aligned chunk of whole texts; their tokens are aligned in one go, as each text's end is a common end."""
        data, starts = _flat(texts)
        n = len(texts)
        fits, found = np.ones(n, bool), []
        for kind, encoder in zip(self.kinds, self.encoders):
            begin = distinct_of(np.concatenate((starts[:-1][np.diff(starts) > 0], self._within(data, starts, kind))))
            ids, sizes, good = encoder.tokens(data, begin, len(data))
            owner = np.searchsorted(starts, begin, "right") - 1
            fits[owner[~good]] = False
            found.append((ids, sizes, owner))
        streams, counts, base = [], np.zeros((n, 3), np.int64), 0
        lengths = np.where(fits, np.diff(starts), 0)
        for k, ((ids, sizes, owner), encoder) in enumerate(zip(found, self.encoders)):
            ids = ids[np.repeat(fits[owner], sizes)]
            counts[:, k] = np.bincount(owner, weights=sizes * fits[owner], minlength=n).astype(np.int64)
            streams += [ids, np.cumsum(encoder.length[ids])]
        t = Tokens(*streams)
        ends = np.cumsum(lengths)
        text, group_text, group_end = self.written.groups(t)
        group_doc = np.repeat(np.arange(n), np.diff(np.searchsorted(group_end, ends, "right"), prepend=0))
        counts[:, 2] = np.bincount(group_doc, minlength=n)
        text_ends = np.zeros(n, np.int64)
        np.maximum.at(text_ends, group_doc, group_text)
        codes, at = links(t)
        doc = np.repeat(np.arange(n), np.diff(np.searchsorted(at, ends, "right"), prepend=0))
        # Codes are numbered so that a document and a code fit one number, which sorts fast.
        distinct, number = _numbered(codes)
        key, times = tally(doc * max(1, len(distinct)) + number)
        return _chunk(doc_ids, counts, text.tobytes(), np.maximum.accumulate(text_ends) if n else text_ends,
                      key // max(1, len(distinct)), distinct, key % max(1, len(distinct)), times)

    @staticmethod
    def _within(data: np.ndarray, starts: np.ndarray, kind) -> np.ndarray:
        """Cuts inside texts: their neighbours on both sides belong to the same text."""
        at = cuts(data, kind.by_words)
        owner = np.searchsorted(starts, at, "right") - 1
        return at[(at > starts[owner]) & (at + 1 < starts[owner + 1])]

    def ranges(self, data: np.ndarray, piece: int) -> list[tuple]:
        """A long text in byte ranges, ``(offset, bytes, range of the first tokenizer, range of the second)``.

        Each tokenizer's range goes from its first cut in the piece to its first cut in the next one; the two
        tokenizers' ranges need not agree. A range without a cut goes to the piece before.
        """
        low = np.arange(0, len(data), piece)
        at = []
        for kind in self.kinds:
            own = np.concatenate(([0], cuts(data, kind.by_words), [len(data)]))
            at.append(np.append(own[np.searchsorted(own, low)], len(data)))
        out = []
        for k in range(len(low)):
            (a0, a1), (b0, b1) = (x[k:k + 2].tolist() for x in at)
            if a0 < a1 or b0 < b1:
                left = min([a0] * (a0 < a1) + [b0] * (b0 < b1))
                right = max([a1] * (a0 < a1) + [b1] * (b0 < b1))
                out.append((left, data[left:right].tobytes(), (a0, a1), (b0, b1)))
        return out

    def fragment(self, offset: int, raw: bytes, a: tuple, b: tuple) -> Fragment:
        data, streams = np.frombuffer(raw, np.uint8), []
        for kind, encoder, (low, high) in zip(self.kinds, self.encoders, (a, b)):
            low, high = low - offset, high - offset
            if low >= high:
                streams += [np.empty(0, np.int32), np.empty(0, np.int64)]
                continue
            at = cuts(data, kind.by_words)
            ids, _, good = encoder.tokens(data, np.append(low, at[(at > low) & (at < high)]), high)
            if not good.all():
                return Fragment(Tokens(), fits=False)
            streams += [ids, offset + low + np.cumsum(encoder.length[ids])]
        return Fragment.of(Tokens(*streams), self.written)

    def finish(self, doc_id: pa.Array, state: tuple) -> bytes:
        done = Fragment.back(state).finished(self.written)
        text = b"".join(done.text)
        return _chunk(doc_id, np.array([[done.n_a, done.n_b, done.n_groups]]), text, np.array([len(text)]),
                      np.zeros(len(done.codes), np.int64), done.codes, np.arange(len(done.codes)), done.times)


def aligned_chunks(docs: DataFrame, first, second, piece: int = 1 << 16, chunk: int = 2 << 20) -> DataFrame:
    """Rows ``(chunk, payload)`` of aligned documents; see ``align``."""
    long_text = F.octet_length("text") > piece
    docs = docs.select("doc_id", "text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        work, number = _aligner(first, second), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = 64 + pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for part in pieces(sizes.astype(np.int64), chunk):
                some = batch.slice(part.start, part.stop - part.start)
                payload = work.documents(some.column("doc_id"), _spaced(some.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary())],
                                                 ["chunk", "payload"])
                number += 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        work, number = _aligner(first, second), (TaskContext.get().partitionId() << 32) + (1 << 31)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                data, _ = _flat(_spaced(one.column("text")))
                for k, r in enumerate(work.ranges(data, piece)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()), pa.array([k], pa.int32()),
                         pa.array([pack((one.column("doc_id"), *r))], pa.binary())], ["chunk", "piece", "payload"])
                number += 1

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _aligner(first, second)
        for batch in batches:
            for c, k, p in zip(*(batch.column(i) for i in range(3))):
                doc_id, *r = unpack(p.as_buffer())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.as_py()], pa.int64()), pa.array([k.as_py()], pa.int32()),
                     pa.array([pack((doc_id, work.fragment(*r).state()))], pa.binary())], ["chunk", "piece", "payload"])

    def composed(table: pa.Table) -> pa.Table:
        work, table = _aligner(first, second), table.sort_by("piece")
        doc_id, whole = None, None
        for p in table.column("payload"):
            doc_id, state = unpack(p.as_buffer())
            one = Fragment.back(state)
            whole = one if whole is None else whole.then(one, work.written)
        return pa.table({"chunk": table.column("chunk")[:1], "piece": table.column("parent")[:1],
                         "payload": pa.array([pack((doc_id, whole.state()))], pa.binary())})

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _aligner(first, second)
        for batch in batches:
            for c, p in zip(batch.column("chunk"), batch.column("payload")):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.as_py()], pa.int64()), pa.array([work.finish(*unpack(p.as_buffer()))], pa.binary())],
                    ["chunk", "payload"])

    whole = docs.where(~F.coalesce(long_text, F.lit(False))).mapInArrow(short, "chunk long, payload binary")
    # Pieces of the longest text, for the height of the tree.
    most = docs.agg(F.max(F.octet_length("text"))).first()[0] or 0
    if most <= piece:
        return whole
    schema = "chunk long, piece int, payload binary"
    found = docs.where(long_text).mapInArrow(split, schema).repartition("chunk", "piece").mapInArrow(tokenized, schema)
    left = -(-(most + 1) // piece)
    while left > 1:
        found = (found.withColumn("parent", F.floor(F.col("piece") / FAN_IN).cast("int"))
                 .groupBy("chunk", "parent").applyInArrow(composed, schema))
        left = -(-left // FAN_IN)
    return whole.union(found.select("chunk", "payload").mapInArrow(finished, "chunk long, payload binary"))


# ---------------------------------------------------------------- counts over all documents

def _places(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order of their buckets; all pairs of a first id share one, which is what "highest" needs."""
    where = (mix((codes >> LOW_BITS).astype(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.lexsort((codes, where))
    return order, where[order]


def _asked(chunks: DataFrame, buckets: int) -> DataFrame:
    def messages(payload, _):
        codes, often = payload[4], payload[5]
        order, where = _places(codes, buckets)
        return where, [codes[order], often[order]]

    return ask(chunks, messages, buckets)


def _counted(asked: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a bucket, in how many documents each is, whether that is its first id's most, and each message's places."""
    codes, where = np.unique(np.concatenate([m[0] for m in asked]), return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, where, np.concatenate([m[1] for m in asked]))
    first = np.flatnonzero(np.append(True, np.diff(codes >> LOW_BITS) != 0))
    highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(codes))))
    return codes, n, n == highest, where


def align(docs: DataFrame, first, second, piece: int = 1 << 16) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each row of ``docs(doc_id, text, ...)``.

    ``groups`` is the alignment, ``a1,a2|b1;a3|b2,b3``: the ids of each group in order. ``n_links`` counts the
    pairs of tokens whose bytes overlap; a pair of ids counts as often as documents hold it linked, ``count_sum``
    sums this over the links, and ``n_best`` counts the links whose pair has the highest count of its first id.
    Documents without tokens (null, empty, or with tokens whose bytes are not the text's) have zeros and an empty
    text. Every row is a document of its own: repeated rows, and rows that share a doc_id, each count. doc_id may
    have any type; other columns are not used. Texts of more than ``piece`` bytes are aligned by several tasks.
    """
    buckets = ask_buckets(docs.sparkSession)

    def reply(asked: list) -> list:
        _, n, best, where = _counted(asked)
        ends = np.cumsum([len(m[0]) for m in asked])[:-1]
        return [(_narrow(n[w]), np.packbits(best[w])) for w in np.split(where, ends)]

    def use(payload, answers: dict) -> Iterator[pa.Table]:
        doc_ids, counts, text, text_ends, codes, _ = payload[:6]
        order, where = _places(codes, buckets)
        count, best = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        got, sizes = answers.get(0, []), np.unique(where, return_counts=True)[1]
        if len(codes):
            count[order] = np.concatenate([_wide(g[0]) for g in got])
            best[order] = np.concatenate([np.unpackbits(g[1], count=k) for g, k in zip(got, sizes)])
        n, pair, times = _pairs(payload)
        ends = np.concatenate(([0], np.cumsum(n)))
        sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (best[pair] * times, count[pair] * times)]
        starts = np.concatenate(([0], text_ends[:-1]))
        written = [text[a:max(a, b - 1)].decode() for a, b in zip(starts.tolist(), text_ends.tolist())]
        yield pa.table({
            "doc_id": doc_ids, "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2],
            "n_links": counts[:, 0] + counts[:, 1] - counts[:, 2], "n_best": sums[0], "count_sum": sums[1],
            "groups": pa.array(written, pa.string())})

    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in numbers),
                           T.StructField("groups", T.StringType())])
    chunks = aligned_chunks(docs, first, second, piece).repartition("chunk")
    return with_answers(chunks, answer(_asked(chunks, buckets), reply), use, schema)


def pair_counts(docs: DataFrame, first, second, piece: int = 1 << 16) -> DataFrame:
    """``a, b, n_docs, best``: each linked pair of ids, in how many documents it is, and whether that is the most of ``a``."""
    def counted(table: pa.Table) -> pa.Table:
        codes, n, best, _ = _counted([unpack(m.as_buffer()) for m in table.column("message")])
        return pa.table({"a": (codes >> LOW_BITS).astype(np.int32), "b": (codes & ((1 << LOW_BITS) - 1)).astype(np.int32),
                         "n_docs": n, "best": best})

    asked = _asked(aligned_chunks(docs, first, second, piece), ask_buckets(docs.sparkSession))
    return asked.groupBy("bucket").applyInArrow(counted, "a int, b int, n_docs long, best boolean")


def digests(aligned: DataFrame) -> DataFrame:
    """The counts, and a SHA-256 digest of the groups; empty without tokens."""
    found = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return aligned.withColumn("groups_sha256", found).drop("groups")


def tokenizers(names: tuple[str, str] = ("byte_bpe_50k.json", "piece_bpe_32k.model")) -> tuple[ByteLevelBpe, PieceBpe]:
    """The two tokenizers from the public files, read on the driver."""
    import public_tokenizers
    import sentencepiece

    with open(public_tokenizers.path(names[0]), encoding="utf-8") as f:
        text = f.read()
    with open(public_tokenizers.path(names[1]), "rb") as f:
        pieces_file = f.read()
    parsed = json.loads(text)
    if parsed["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError(f"{names[0]} is not byte-level")
    ids = [*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"])]
    size = sentencepiece.SentencePieceProcessor(model_proto=pieces_file).get_piece_size()
    return ByteLevelBpe(text, max(ids) + 1), PieceBpe(pieces_file, size)
