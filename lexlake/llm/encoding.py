"""Batch encoding with public tokenizers, for use inside tasks.

White space ends a chunk in both vocabularies' pre-tokenizers, so a text's ids are those of its
chunks. Arrow cuts texts into chunks and finds the distinct ones; each is encoded once by the
tokenizers library and kept in a table of bounded size, which its task drops at its end; when the table is full,
what was met often stays. Of a chunk that is one word of common letters with at most some marks after it, the table has the
word alone; words go to the library's BPE model many at a time, other chunks
through its whole chain. Texts that hold the string of an added token, long runs of
white space, or characters on which the cut and the tokenizer might differ, are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
import string
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Vocabulary file and the way a text of it falls into chunks.
WORD_VOCAB, BYTE_VOCAB = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Controls, unusual spaces, marks that combine with the character before: such texts are encoded whole.
_ODD = r"[\x00-\x08\x0e-\x1f\x7f-\x{a0}\x{300}-\x{36f}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
#: In byte-level vocabularies a run of two blanks before a word is two chunks; longer ones, or two at the end, are not cut so.
_BLANKS = r"[\x09-\x0d ][\x09-\x0d ](?:[\x09-\x0d ]|\z)"
#: A word of Latin letters, and the marks that may follow it.
_LETTERS, _MARKS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+", ".,;:!?"
#: Marks at the head of a part: a line's beginning, a text's beginning, a whole text. Byte-level parts without one begin after a space.
_LINE, _FIRST, _WHOLE = "\x01", "\x02", "\x03"
#: Byte-level vocabularies write each byte as a character: printable ones as themselves, others from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip(_SELF, map(chr, _SELF), strict=True))
_BYTES |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _BYTES)}
_UTF16 = np.array([ord(_BYTES[b]) for b in range(256)], "<u2")
#: Words handed to the library in one call.
_AT_ONCE = 10_000


#: Ids on end; of each number where its own begin, and how many they are.
Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def _lines(parts: pa.Array) -> str:
    """Parts, a line each."""
    return pc.binary_join(pa.LargeListArray.from_arrays([0, len(parts)], parts), pa.scalar("\n", parts.type))[0].as_py()


def _strings(parts: pa.Array) -> list[str]:
    return parts.to_numpy(zero_copy_only=False).tolist()


def _joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids on end, and the length of each."""
    length = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), length


def _runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    total = np.cumsum(length)
    return np.repeat(first - total + length, length) + np.arange(total[-1] if len(total) else 0)


@functools.lru_cache(4)
def _tokenizer(vocabulary: str, special_as_text: bool):
    """The library's tokenizer, read once in a process: a worker runs many tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    path = vocabulary
    if os.path.sep not in vocabulary:
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


@functools.lru_cache(4)
def _word_tokenizer(vocabulary: str):
    """The model of a byte-level vocabulary behind a cut at line feeds, and the bytes of every id; none if a byte has no id of its own."""
    from tokenizers import Tokenizer, pre_tokenizers

    words = Tokenizer(_tokenizer(vocabulary, False).model)
    words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_BYTES[10])
    suffix, known = words.model.end_of_word_suffix or "", words.get_vocab()
    if words.model.continuing_subword_prefix or not all(c in known and c + suffix in known for c in _BYTES.values()):
        return None
    sizes = np.zeros(1 + max(known.values()), np.int64)
    sizes[list(known.values())] = [len(token.removesuffix(suffix)) for token in known]
    return words, sizes


class Encoder:
    """Encodes arrays of texts with one vocabulary file, given by its path or its public name, as the library does
    without special tokens around a text. ``special_as_text``: the strings of added tokens are ordinary text. ``table_bytes`` bounds the
    table of chunks, about ``ENTRY`` bytes and its text for each."""

    ENTRY = 130

    def __init__(self, vocabulary: str, table_bytes: int = 32_000_000, special_as_text: bool = False):
        self.tokenizer = _tokenizer(vocabulary, special_as_text)
        self.spaced = "ByteLevel" in type(self.tokenizer.pre_tokenizer).__name__
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.uncut = "|".join([_ODD, *([_BLANKS] if self.spaced else []), *added])
        self.model, self.words = self.tokenizer.model, _word_tokenizer(vocabulary)
        self.line = self._ids(["\n"])[0][0] if self.spaced else None
        # byte-level vocabularies take any run of marks as one chunk
        self.marks = string.punctuation if self.spaced else _MARKS
        self.plain = f"^[{_FIRST}{_LINE}]?{_LETTERS}[{re.escape(self.marks)}]*$" if self.words else None
        self.table_bytes = table_bytes
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.first, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        """Drop from the table what was not met again since it came, or since the last time, and the least met beyond half its size."""
        cost = self.ENTRY + np.fromiter(map(len, self.known), np.int64, len(self.known))
        often = np.argsort(-self.met, kind="stable")
        stay = (self.met[often] > 0) & (np.cumsum(cost[often]) <= self.table_bytes // 2)
        stay = np.sort(often[stay])
        mark = np.zeros(len(cost), bool)
        mark[stay] = True
        self.known = dict(zip(compress(self.known, mark.tolist()), range(len(stay)), strict=True))
        self.held, self.met = int(cost[stay].sum()), np.zeros(len(stay), np.int32)
        length = self.length[stay]
        self.flat, self.first, self.length = self.flat[_runs(self.first[stay], length)], np.cumsum(length) - length, length

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, part: str) -> str:
        """The text that a part stands for."""
        mark = part[:1]
        if mark == _LINE:
            return "\n" + part[1:]
        if mark in (_FIRST, _WHOLE) and mark:
            return part[1:]
        return " " + part if self.spaced else part

    def _known(self, parts: pa.Array) -> np.ndarray:
        """The numbers of parts in the table, -1 for new ones."""
        return np.fromiter(map(self.known.get, _strings(parts), repeat(-1)), np.int64, len(parts))

    def _keep(self, parts: pa.Array, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Add parts with their ids to the table; their numbers."""
        numbers = len(self.known) + np.arange(len(parts))
        self.known.update(zip(_strings(parts), numbers.tolist(), strict=True))
        self.held += self.ENTRY * len(parts) + (pc.sum(pc.binary_length(parts)).as_py() or 0)
        self.first = np.append(self.first, np.cumsum(length) - length + len(self.flat))
        self.length = np.append(self.length, length)
        self.flat = np.append(self.flat, ids)
        self.met = np.append(self.met, np.zeros(len(parts), np.int32))
        return numbers

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """Add new parts to the table; their numbers."""
        plain = pc.match_substring_regex(parts, self.plain) if self.plain else pa.array(np.zeros(len(parts), bool))
        at = plain.to_numpy(zero_copy_only=False)
        rest = parts.filter(pc.invert(plain))
        plain = parts.filter(plain)
        numbers = np.empty(len(parts), np.int64)
        if len(plain):
            numbers[at] = self._keep(plain, *self._words(plain))
        if len(rest):
            numbers[~at] = self._keep(rest, *_joined(self._ids([self._chunk(p) for p in _strings(rest)])))
        return numbers

    def _looked_up(self, parts: pa.Array) -> np.ndarray:
        """The numbers of distinct parts in the table, new ones added."""
        number = self._known(parts)
        new = number < 0
        self.met[number[~new]] += 1
        if new.any():
            number[new] = self._learn(parts.filter(pa.array(new)))
        return number

    def _numbered(self, parts: pa.Array) -> tuple[np.ndarray, Table]:
        """The numbers of distinct parts, and what they stand for: the table, and after its end plain words with marks, put
        together from the word's ids and the marks'."""
        if not self.plain:
            return self._looked_up(parts), (self.flat, self.first, self.length)
        bare = pc.if_else(pc.match_substring_regex(parts, self.plain), pc.ascii_rtrim(parts, characters=self.marks), parts)
        words = bare.dictionary_encode()
        numbers = self._looked_up(words.dictionary)[words.indices.to_numpy()]
        extra = pc.subtract(pc.binary_length(parts), pc.binary_length(bare)).to_numpy()
        marked = np.flatnonzero(extra)
        after: dict[str, int] = {}
        mark = [after.setdefault(p[-n:], len(after)) for p, n in zip(_strings(parts.take(pa.array(marked))), extra[marked].tolist(), strict=True)]
        ids, size = _joined([[t.id for t in self.model.tokenize(m)] for m in after])
        # each is two runs of ids: its word's in the table, its marks' after the table's end
        word, flat = numbers[marked], np.concatenate((self.flat, ids))
        first = np.column_stack((self.first[word], (np.cumsum(size) - size + len(self.flat))[mark])).ravel()
        length = np.column_stack((self.length[word], size[mark]))
        both = length.sum(axis=1)
        numbers[marked] = len(self.first) + np.arange(len(marked))
        table = (np.concatenate((self.flat, flat[_runs(first, length.ravel())])), np.concatenate((self.first, len(self.flat) + np.cumsum(both) - both)), np.concatenate((self.length, both)))
        return numbers, table

    def _words(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids on end, and how many each has, of plain words, by the library's model alone."""
        words, size_of = self.words
        ids, sizes = [], []
        for k in range(0, len(parts), _AT_ONCE):
            text = "\n" + _lines(parts.slice(k, _AT_ONCE))
            text = text.replace("\n", "\n ").replace(" " + _LINE, "").replace(" " + _FIRST, "") if self.spaced else text.lower()
            octets = np.frombuffer((text[1:] + "\n").encode(), np.uint8)
            lines = _UTF16[octets].tobytes().decode("utf-16-le")
            ids.append(np.array(words.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32))
            # an id's bytes end where a word ends, line feeds left out, if it is that word's last
            ends = np.flatnonzero(octets == 10)
            upto = np.searchsorted(np.cumsum(size_of[ids[-1]]), ends - np.arange(len(ends)), "right")
            sizes.append(np.diff(upto, prepend=0))
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        if self.spaced:
            begins = pc.starts_with(parts, _LINE).to_numpy(zero_copy_only=False)
            ids = np.insert(ids, (np.cumsum(sizes) - sizes)[begins], self.line)
            sizes += begins
        return ids, sizes

    def _parts(self, texts: pa.Array) -> pa.ListArray:
        if not self.spaced:
            return pc.ascii_split_whitespace(texts)
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_FIRST, texts.type), texts, pa.scalar("", texts.type)), "\n", " " + _LINE)
        return pc.split_pattern(marked, " ")

    def numbers(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, Table]:
        """Numbers of all texts' parts on end, where each text's begin (one more at the end), and what the numbers stand for."""
        if self.held > self.table_bytes:
            self._shrink()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        uncut = pc.match_substring_regex(texts, self.uncut)
        whole = np.flatnonzero(uncut.to_numpy(zero_copy_only=False))
        cut = self._parts(pc.if_else(uncut, pa.scalar("", texts.type), texts) if len(whole) else texts)
        flat = cut.flatten().dictionary_encode()
        keys = flat.dictionary
        if len(whole):
            keys = pc.unique(pa.concat_arrays([keys, pa.array([_WHOLE + texts[i].as_py() for i in whole.tolist()], keys.type)]))
        number, table = self._numbered(keys)
        found = number[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(cut.value_lengths().to_numpy())))
        if len(whole):
            each = np.split(found, ends[1:-1])
            own = number[pc.index_in(pa.array([_WHOLE + texts[i].as_py() for i in whole.tolist()], keys.type), keys).to_numpy()]
            for i, k in zip(whole.tolist(), own.tolist(), strict=True):
                each[i] = np.array([k], np.int64)
            found, ends = np.concatenate(each), np.cumsum([0, *map(len, each)])
        return found, ends, table

    def lengths(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """Tokens of each text; null: 0."""
        numbers, ends, (_, _, length) = self.numbers(texts)
        total = np.concatenate(([0], np.cumsum(length[numbers])))
        return total[ends[1:]] - total[ends[:-1]]

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end (uint32), each with ``end_id`` after it, and where each text's begin."""
        numbers, ends, (flat, first, length) = self.numbers(texts)
        lengths = length[numbers]
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[_runs(first[numbers], lengths)]
        starts = total[ends]
        if end_id is not None:
            ids = np.insert(ids, starts[1:], end_id)
            starts = starts + np.arange(len(starts))
        return ids, starts


def pieces(batch: pa.RecordBatch, most: int = 4_000_000, rows: int = 4096) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_id and text of a batch in runs of about ``most`` bytes of text at most."""
    sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = min(n, begin + rows, max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + most, "right")) - 1))
        yield batch.column("doc_id").slice(begin, end - begin), batch.column("text").slice(begin, end - begin)
        begin = end


class PieceEncoder(Encoder):
    """Encodes arrays of texts with a sentencepiece model, given by its path or its public name. Its pieces begin with a space or hold
    none, runs of spaces aside, so a text's ids are those of its words; texts with such runs, or with U+2581 itself, are encoded whole."""

    def __init__(self, vocabulary: str, table_bytes: int = 32_000_000):
        import sentencepiece

        path = vocabulary
        if os.path.sep not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.uncut, self.plain = r"[\x00-\x08]|  |^ | \z|\x{2581}", None
        self.table_bytes = table_bytes
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def _learn(self, parts: pa.Array) -> np.ndarray:
        return self._keep(parts, *_joined(self._ids([p.removeprefix(_WHOLE) for p in _strings(parts)])))

    def _parts(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(texts, " ")


def byte_level_tokens(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    back = {c: b for b, c in _BYTES.items()}
    found = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        found[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return found


def piece_tokens(model) -> list[bytes]:
    """The bytes of every id of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
