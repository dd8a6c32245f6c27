"""Token counts by prefix dynamic programming.

A byte-level BPE splits a text into pieces and merges inside each piece.  The encoding of the first i bytes of a
piece is the encoding of fewer bytes and one token t more, for the one t ending at i that merges with nothing in
the token before it.  That is a dynamic program over the bytes of the piece: ``count[i] = count[i - len(t)] + 1``.
It runs once for each different piece of a worker.

``prefix_tables`` strings the pieces' tables together to a table of the text: how many tokens every prefix has
that ends between characters, the whole text among them.  Where a prefix would be split into other pieces than
the text (inside a special string, a contraction, or at the end of white space), it is counted as it would be
split.  A table is one small integer a byte, the difference to the prefix before; tables are written once, and
``token_counts`` and ``PrefixCounts`` answer from them how many tokens a text or any prefix has, whether it fits
into a budget and where it would be cut, without encoding again.

Null and empty texts have no tokens.  Special strings inside texts count as the library's default has it: as one
special token.  Repeated rows are counted each.  An empty table gives an empty result.
"""

from __future__ import annotations

import array
import base64
import functools
import json
import operator
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Workspace, blocks, texts_of

#: Beyond these characters two libraries' tables of letters might differ, so the one whose counts are asked for splits the text.
_UNUSUAL = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
#: Characters of a class below U+0250; the further usual ones are punctuation.
_CLASS = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
_BLANK = "\\t-\\r \x85\xa0"
_L, _N, _S = _CLASS["L"], _CLASS["N"], _BLANK
#: The split of usual texts.  A run of white space leaves its last character to what follows.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: White space as Unicode has it, two characters or more before something else.
_WHITE = _BLANK + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"[{_WHITE}]{{2,}}(?=[^{_WHITE}])")
#: Contractions of which a prefix is split into two pieces.
_LONG_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))
#: Stands in a table at bytes inside a character.
INSIDE = -128
_TWO = (2,)
#: Pieces that a worker remembers of late and from before, pairs of tokens, and bytes of the longest piece.
_REMEMBERED, _PAIRS, _SHORT = 150_000, 400_000, 64


class Encoder:
    """Ids as the library for a .json vocabulary gives them, and counts of all prefixes."""

    def __init__(self, json_path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        with open(json_path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.allowed = set(self.special)
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        #: Sizes of the tokens of two bytes or more that end with given three bytes, the longest first.
        found: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                found.setdefault(token[-3:], {2}).add(len(token))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}
        self.base = max(ranks.values()) + 1
        most = max(map(len, ranks))
        self.step = np.dtype(np.int8 if most < 127 + 2 else np.int16)
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._apart: dict[int, bool] = {}
        self._tables: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        if _UNUSUAL.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=self.allowed)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        if _UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in self.exact.pre_tokenizer.pre_tokenize_str(text)]
        return _PIECES.findall(text)

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of two tokens together is these two."""
        if len(self._apart) > _PAIRS:
            self._apart.clear()
        said = self._apart[left * self.base + right] = self.fast._encode_single_piece(self.token[left] + self.token[right]) == [left, right]
        return said

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of the first 0, 1, ... bytes of a piece, by dynamic programming over its bytes."""
        count, last = [0], [-1]
        rank, sizes, apart, base = self.ranks.get, self.sizes.get, self._apart.get, self.base
        for i in range(1, len(piece) + 1):
            for size in sizes(piece[i - 3 : i], _TWO) if i > 2 else _TWO:
                if size >= i:
                    if size > i or (token := rank(piece[:i])) is None:
                        continue
                    break
                if (token := rank(piece[i - size : i])) is None:
                    continue
                before = last[i - size]
                if (said := apart(before * base + token)) is None:
                    said = self._stay_apart(before, token)
                if said:
                    break
            else:
                size, token = 1, rank(piece[i - 1 : i])  # the one byte alone, if nothing longer fits
            count.append(count[i - size] + 1)
            last.append(token)
        return count

    def _table(self, piece: str) -> bytes:
        """The steps of a piece's table: at each character's end the difference to the one before."""
        if (held := self._tables.get(piece)) is not None:
            return held
        held = self._before.get(piece)
        if held is None:
            raw = piece.encode()
            count = self.counts(raw)
            if piece in _LONG_CONTRACTIONS:
                count[2] = 2
            if len(raw) > len(piece):  # a byte within a character is no prefix's end
                ends = [0, *(k for k in range(1, len(raw)) if raw[k] & 0xC0 != 0x80), len(raw)]
                steps = [INSIDE] * len(raw)
                for a, b in zip(ends, ends[1:], strict=False):
                    steps[b - 1] = count[b] - count[a]
                held = array.array(self.step.char, steps).tobytes()
            else:
                held = array.array(self.step.char, map(operator.sub, count[1:], count)).tobytes()
        if len(piece) <= _SHORT:
            if len(self._tables) >= _REMEMBERED:
                self._before, self._tables = self._tables, {}
            self._tables[piece] = held
        return held

    def _steps(self, raw: bytes, count: np.ndarray) -> np.ndarray:
        """count of 0, 1, ... bytes as differences from one character's end to the next."""
        starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        ends = np.flatnonzero(np.append(starts[1:], True)) if raw else np.zeros(0, np.int64)
        out = np.full(len(raw), INSIDE, self.step)
        out[ends] = np.diff(count[np.append(0, ends + 1)])
        return out

    def _plain(self, text: str) -> np.ndarray:
        """The table of a text without special strings."""
        held = self._tables.get
        parts = [held(p) or self._table(p) for p in self.pieces(text)]
        steps = np.frombuffer(b"".join(parts), self.step)
        for run in _RUNS.finditer(text):
            # a prefix that ends with the run has it as one piece, the whole text leaves the last character to the next one
            blanks = run.group()
            more = self.total(self._table(blanks)) - self.total(self._table(blanks[:-1])) - self.total(self._table(blanks[-1]))
            if more:
                steps = steps if steps.flags.writeable else steps.copy()
                end = len(text[: run.end()].encode())
                steps[end - 1] += more
                at = end
                while steps[at] == INSIDE:
                    at += 1
                steps[at] -= more
        return steps

    @staticmethod
    def total(steps: bytes | np.ndarray, step: np.dtype = np.dtype(np.int8)) -> int:
        """Tokens of all that a table covers."""
        held = np.frombuffer(steps, step) if isinstance(steps, bytes) else steps
        return int(held.sum(dtype=np.int64)) - INSIDE * int((held == INSIDE).sum())

    def table(self, text: str) -> np.ndarray:
        """The table of a text: at each byte that ends a character, how many tokens more the prefix to there has than the one before."""
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        out, before, open_text = [], 0, ""
        for part in self._cut.split(text):
            if part in self.special:
                # a prefix that ends inside is ordinary text, which may go on from the last piece before
                last = self.pieces(open_text)[-1:] if open_text else []
                from_here = last[0] if last else ""
                own = self.total(self._plain(from_here))
                count = [0] + [self.total(self._plain(from_here + part[:k])) - own for k in range(1, len(part))] + [1]
                out.append(self._steps(part.encode(), np.array([count[len(part.encode()[:k].decode(errors="ignore"))] for k in range(len(part.encode()) + 1)])))
                open_text = ""
            elif part:
                out.append(self._plain(part))
                open_text = part
        return np.concatenate(out) if out else np.zeros(0, self.step)


@functools.lru_cache(2)
def encoder(json_path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    return Encoder(json_path)


class PrefixCounts:
    """Answers from one text's table."""

    def __init__(self, steps: np.ndarray):
        #: Bytes of each prefix that ends between characters, and its tokens.
        self.ends = np.flatnonzero(steps != INSIDE) + 1
        self.counts = np.cumsum(steps[self.ends - 1], dtype=np.int64)

    @property
    def total(self) -> int:
        return int(self.counts[-1]) if len(self.counts) else 0

    def fits(self, budget: int) -> bool:
        return self.total <= budget

    def at(self, n_bytes: int) -> int:
        """Tokens of the text's first n_bytes bytes; inside a character, of the whole ones."""
        k = int(np.searchsorted(self.ends, n_bytes, "right"))
        return int(self.counts[k - 1]) if k else 0

    def truncation(self, budget: int) -> int:
        """Bytes of the longest prefix with at most budget tokens."""
        fitting = np.flatnonzero(self.counts <= budget)
        return int(self.ends[fitting[-1]]) if len(fitting) else 0


def prefix_tables(docs: DataFrame, json_path: str) -> DataFrame:
    """doc_id and steps, the table of each row's text, built where the text lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(json_path)
        for rows, _, _ in blocks(batches):
            steps = [enc.table(x.as_py()).tobytes() for x in rows.column("text")]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(steps, pa.binary())], ["doc_id", "steps"])

    return texts_of(docs).mapInArrow(run, "doc_id long, steps binary")


def answered(tables: DataFrame, json_path: str, answers: Callable[[PrefixCounts], tuple], columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """doc_id and what ``answers`` says to each stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = encoder(json_path).step
        for batch in batches:
            said = [answers(PrefixCounts(np.frombuffer(x.as_buffer(), step))) for x in batch.column("steps")]
            lists = [list(c) for c in zip(*said, strict=True)] or [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(lists, columns.values(), strict=True))], ["doc_id", *columns])

    return tables.mapInArrow(run, "doc_id long, " + schema)


def token_counts(docs: DataFrame, json_path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) and kept_bytes (bytes of the longest prefix
    with at most limit tokens) for each row, read off the stored tables."""
    tables = Workspace(docs.sparkSession, "tokens").write(prefix_tables(docs, json_path), "prefixes")

    def answers(table: PrefixCounts) -> tuple:
        return int(table.ends[-1]) if len(table.ends) else 0, table.total, not table.fits(limit), table.truncation(limit)

    kinds = {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_(), "kept_bytes": pa.int64()}
    return answered(tables, json_path, answers, kinds, "n_bytes long, n_tokens long, over_limit boolean, kept_bytes long")
