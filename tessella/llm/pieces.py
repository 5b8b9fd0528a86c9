"""SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

A sequence of tokens is the merge encoding of a text exactly if every two neighbours are what merging their joined text
gives. So an encoder takes the longest piece at each place, checks it against its neighbour by merging the two again, falls
back to shorter pieces and then to the previous token, and marks places from which no encoding goes on in a bitfield, so
that each is tried once. The pieces at each place come from one pass of an Aho-Corasick automaton.

A text is cut where no piece could span the cut, at white space runs and characters that no longer piece contains, so that
the encodings of frequent parts are kept in a bounded cache. A model whose pieces do span white space is not cut there.

Defined results: a null text is empty, and encodes to the end id alone. Characters without a piece become the pieces of
their UTF-8 bytes. Rows that repeat are encoded each. Other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tessella.llm.textarrays import release_memory

SPACE = "▁"
#: Parts, and pairs of tokens, whose results a task keeps, and the length from which parts are not kept.
CACHE, LONG = 250_000, 64
#: Code points of texts that are encoded before a batch is handed on.
BATCH_CHARS = 500_000


class _Parts(dict):
    """The ids of parts of texts, those of the last CACHE distinct short ones at least and of twice as many at most."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, part: str) -> bytes:
        if len(part) >= LONG:
            return self.encode(part)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        out = self[part] = self.old.get(part) or self.encode(part)
        return out


class Codec:
    """A model's pieces. Models that change texts before encoding, or have no byte pieces, are not supported."""

    def __init__(self, model: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.last = array("i", [lib.eos_id()]).tobytes()
        ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.bytes = [-1] * 256
        self.text = [""] * lib.get_piece_size()
        self.pieces: dict[str, int] = {}
        self.score = {}
        for i in ids:
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                byte = int(piece[3:5], 16)
                self.bytes[byte], self.text[i] = i, bytes([byte]).decode(errors="surrogateescape")
            else:
                self.pieces[piece], self.score[piece], self.text[i] = i, lib.get_score(i), piece.replace(SPACE, " ")
        self.text[lib.unk_id()] = lib.decode([lib.unk_id()])
        self.spaced = {i for p, i in self.pieces.items() if p.startswith(SPACE)}
        if -1 in self.bytes or lib.normalize("ﬁéé  \t x ") != SPACE + "ﬁéé  \t x ".replace(" ", SPACE):
            raise ValueError("a model with byte pieces and without normalization is needed")
        longer = [p for p in self.pieces if len(p) > 1]
        inner = {c for p in longer for c in p}
        self.automaton = ahocorasick.Automaton()
        for p in longer:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.spelled = {p: p for p in self.pieces}
        self.shorter = {p: next(p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in self.pieces) for p in longer}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer):
            self.cut = re.compile(r"(?s).+")
        else:
            pairs = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
            marks = {c for c in inner - {SPACE} if not c.isalnum()}
            marks -= {b for a, b in pairs if a.isalnum()}  # no piece has these after a letter or digit
            word = {c for c in inner if c.isalnum()}
            kinds = ["".join(map(re.escape, sorted(x))) for x in (marks, word, inner - marks - word - {SPACE})]
            self.cut = re.compile("{s}*[{0}]*(?:[{1}]+|[{2}][{0}]*)+|{s}*[{0}]+|{s}+|(?s:.)".format(*kinds, s=SPACE))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts = _Parts(self.part)

    def merge(self, text: str) -> list[str]:
        """The merge encoding by definition: join the neighbours with the best score, the first of these, until none join."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging gives these two tokens again; left is empty at the start of a text."""
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        left, right = self.spelled.get(left, left), self.spelled.get(right, right)  # one string for each piece
        known = self.pairs[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces and lone characters of text."""
        n = len(text)
        longest = array("H", bytes(2 * n + 2))  # nought where only a lone character begins
        for end, size in self.automaton.iter(text):  # by ascending end, so the longest at each place is last
            longest[end - size + 1] = size
        known, compatible, shorter = self.pairs.get, self.compatible, self.shorter.get
        failed = bytearray((n >> 3) + 1)  # a bit for each position from which no encoding goes on
        tokens: list[str] = []
        pos, last, token = 0, "", text[: longest[0] or 1]
        while True:
            while token is not None:
                end = pos + len(token)
                if not failed[end >> 3] >> (end & 7) & 1:
                    good = known((last, token))
                    if good or good is None and compatible(last, token):
                        break
                token = shorter(token)
            if token is None:
                failed[pos >> 3] |= 1 << (pos & 7)
                token = tokens.pop()
                pos -= len(token)
                last, token = tokens[-1] if tokens else "", shorter(token)
            else:
                tokens.append(token)
                if end == n:
                    return tokens
                pos, last, token = end, token, text[end : end + (longest[end] or 1)]

    def part(self, text: str) -> bytes:
        ids, known = [], self.pieces.get
        for token in self.backtrack(text):
            i = known(token)
            if i is None:
                ids.extend([self.bytes[b] for b in token.encode()])
            else:
                ids.append(i)
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        found = self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return np.frombuffer(b"".join([*map(self.parts.__getitem__, found), self.last]), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        out = "".join(map(self.text.__getitem__, ids))
        if not out.isascii():
            try:
                out.encode()
            except UnicodeEncodeError:  # pieces of bytes from 128 on, which control pieces part
                runs = [list(run) for some, run in groupby(ids, lambda i: bool(self.text[i])) if some]
                out = "".join([_utf8("".join([self.text[i] for i in run]).encode(errors="surrogateescape")) for run in runs])
        first = next((i for i in ids if self.text[i]), None)
        return out[1:] if first in self.spaced else out


def _utf8(run: bytes) -> str:
    """Each byte that is not part of a valid character becomes one replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            i += n
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    """One for each Python worker."""
    return Codec(model)


def encode(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars and ids (the end id last) of each of documents."""
    return _encoded(documents, model, False)


def round_trip(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and decoded, as decode() gives of encode(), by one Python worker a task in place of two."""
    return _encoded(documents, model, True)


def _encoded(documents: DataFrame, model: str, decoded: bool) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for batch in batches:
            row = 0
            while row < batch.num_rows:
                start, rows, back, chars = row, [], [], 0
                while row < batch.num_rows and chars < BATCH_CHARS:
                    text = batch.column("text")[row].as_py() or ""
                    rows.append(code.encode(text))
                    if decoded:
                        back.append(code.decode(rows[-1].tolist()))
                    chars += len(text)
                    row += 1
                ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), pa.int32()))
                columns = {"doc_id": batch.column("doc_id").slice(start, row - start), "ids": ids}
                yield pa.RecordBatch.from_pydict(columns | ({"decoded": pa.array(back, pa.string())} if decoded else {}))
        code.parts.old.clear()
        release_memory()

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text that they stand for, of rows with doc_id and ids. Null ids are none."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                texts = [code.decode(ids.values.to_pylist() if ids.is_valid else []) for ids in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
        release_memory()

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
