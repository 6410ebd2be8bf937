"""Encoding of whole corpora with a public byte-level BPE, by a bounded-lookahead streaming transducer.

Text enters in windows of fixed size. The pattern splits a window into pieces; all pieces but the last few
are settled whatever follows, and only the unsettled rest stays. Inside a piece longer than a window, tokens
are settled as soon as ``lookahead`` bytes follow them: that many, computed from the merge list, are as far as
later bytes can reach back. So memory is a window, however long the text, and the ids are those of encoding it whole.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that are looked at together.
WINDOW = 2048
#: Pieces at a window's end that more text could change: the last one, and before it the quote of a contraction.
UNSETTLED = 2


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The merge list: lines of a token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def _merge(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The piece after all merges of ranks under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after a token's end, at most, on which it can depend that the merges build this token.

    A merge of u and v is undone by later bytes only if a merge of higher rank takes v, or a right part of v or
    of u while it is being built, together with what follows; that merge reaches over its own right half and
    as far beyond as its own undoing. Going through the merges by rank gives every token's reach in one pass.
    """
    reach: dict[bytes, int] = {}
    taken: dict[bytes, int] = {}  # as a left half so far: the farthest reach of a merge that takes it
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            reach[token] = 0
            continue
        halves = _merge(token, ranks, rank)
        if len(halves) != 2:
            raise ValueError("not a merge list: a token isn't made of two earlier ones")
        u, v = halves
        reach[token] = max(taken.get(v, 0), reach[v], reach[u] - len(v), 0)
        taken[u] = max(taken.get(u, 0), len(v) + reach[token])
    return max(reach.values(), default=0)


class Vocabulary:
    """A merge list, compiled once in each process."""

    def __init__(self, data: bytes) -> None:
        self.ranks = read_ranks(data)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.encoding = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self._lookahead: int | None = None

    @property
    def lookahead(self) -> int:
        if self._lookahead is None:
            self._lookahead = sufficient_lookahead(self.ranks)
        return self._lookahead

    def encode(self, text: str | None, window: int = WINDOW) -> list[int]:
        """The ids of a text; of null and empty ones none."""
        if not text:
            return []
        encoder = Encoder(self, window)
        ids = [i for at in range(0, len(text), window) for i in encoder.feed(text[at : at + window])]
        return ids + encoder.finish()


@lru_cache(maxsize=4)
def vocabulary_of(data: bytes) -> Vocabulary:
    return Vocabulary(data)


class Encoder:
    """Text in, ids out: ``feed`` gives the ids that are settled, ``finish`` the rest."""

    def __init__(self, vocabulary: Vocabulary, window: int = WINDOW) -> None:
        self._v, self._window = vocabulary, window
        self._rest = ""  # text of unsettled pieces
        self._inside = b""  # unsettled bytes of a piece longer than a window, whose start is out already
        self._kind: regex.Pattern | None = None  # what continues that piece

    def feed(self, text: str) -> list[int]:
        ids: list[int] = []
        if self._kind is not None:
            text = self._continue(text, ids)
        self._rest += text
        pieces = self._v.pattern.findall(self._rest)
        self._give(pieces[:-UNSETTLED], ids)
        if pieces and len(pieces[-1]) > max(self._window, 3):
            self._give(pieces[-UNSETTLED:-1], ids)  # no contraction is that long
            self._enter(pieces[-1], ids)
        return ids

    def _give(self, pieces: list[str], ids: list[int]) -> None:
        for p in pieces:
            ids += self._v.encoding._encode_single_piece(p)
        self._rest = self._rest[sum(map(len, pieces)) :]

    def _enter(self, piece: str, ids: list[int]) -> None:
        """Goes inside a long piece. White space keeps its last character back, which belongs to a word that follows."""
        kind = next(k for k in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+") if regex.match(k, piece[-1]))
        self._rest = piece[-1] if kind == r"\s+" else ""
        self._inside, self._kind = piece[: len(piece) - len(self._rest)].encode(), regex.compile(kind)
        self._settle(ids)

    def _continue(self, text: str, ids: list[int]) -> str:
        """Takes what still belongs to the long piece, and gives back the text after it."""
        if self._kind.pattern == r"\s+":
            text, self._rest = self._rest + text, ""
            run = self._kind.match(text)
            end = run.end() if run else 0
            if end == len(text):  # the run may go on
                self._inside += text[:-1].encode()
                self._rest = text[-1:]
                self._settle(ids)
                return ""
            own = max(0, end - 1)  # the last one belongs to the word that follows
        else:
            run = self._kind.match(text)
            own = run.end() if run else 0
            if own == len(text):
                self._inside += text.encode()
                self._settle(ids)
                return ""
        self._inside += text[:own].encode()
        ids += self._v.encoding._encode_single_piece(self._inside) if self._inside else []
        self._inside, self._kind = b"", None
        return text[own:]

    def _settle(self, ids: list[int]) -> None:
        """Gives out the tokens of the long piece that end ``lookahead`` bytes before its known end."""
        if len(self._inside) <= self._v.lookahead:
            return
        found = self._v.encoding._encode_single_piece(self._inside)
        at, sure = 0, len(self._inside) - self._v.lookahead
        for k in found:
            end = at + len(self._v.tokens[k])
            if end > sure:
                break
            ids.append(k)
            at = end
        self._inside = self._inside[at:]

    def finish(self) -> list[int]:
        ids: list[int] = []
        if self._inside:
            # a space run that ends the text is one piece to its end
            tail = self._rest if self._kind.pattern == r"\s+" else ""
            ids += self._v.encoding._encode_single_piece(self._inside + tail.encode())
            self._rest = self._rest[len(tail) :]
        if self._rest:
            ids += self._v.encoding.encode_ordinary(self._rest)
        self._rest, self._inside, self._kind = "", b"", None
        return ids


class Decoder:
    """Ids in, text out: bytes that end inside a character wait for its rest."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self._tokens = vocabulary.tokens
        self._text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self._text.decode(b"".join(map(self._tokens.__getitem__, ids)))

    def finish(self) -> str:
        return self._text.decode(b"", final=True)


def _over_texts(df: DataFrame, keep: list[str], text: str, out: str, kind: str, to_array: Callable[[Vocabulary, list], pa.Array], vocabulary: str) -> DataFrame:
    """``keep`` and a column made of ``text`` batch by batch; the vocabulary, of fixed size, goes along as a broadcast."""
    with open(vocabulary, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(data.value)
        for b in batches:
            made = to_array(v, b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), made], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, f"{fields}, `{out}` {kind}")


def _lists(lists: list[list[int]]) -> pa.Array:
    offsets, flat = [0], []
    for x in lists:
        flat += x
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode_texts(df: DataFrame, keep: list[str], text: str, out: str = "ids", vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """``keep`` and the ids of every text, in the rows' own partitions, without a shuffle.

    Null, empty and repeated texts and texts of any length have ids (null and empty ones an empty list); text
    that looks like a special token is ordinary text. Other columns are left out.
    """
    return _over_texts(df, keep, text, out, "array<int>", lambda v, texts: _lists([v.encode(t, window) for t in texts]), vocabulary)


def count_tokens(df: DataFrame, keep: list[str], text: str, out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and the number of ids of every text; 0 for null and empty ones."""
    return _over_texts(df, keep, text, out, "bigint", lambda v, texts: pa.array([len(v.encode(t)) for t in texts], pa.int64()), vocabulary)


def decode_ids(df: DataFrame, keep: list[str], ids: str, out: str = "text", vocabulary: str = VOCABULARY, step: int = 4096) -> DataFrame:
    """``keep`` and the text of every list of ids, read ``step`` ids at a time; of null and empty lists the empty text."""

    def text_of(v: Vocabulary, found: list[int] | None) -> str:
        decoder = Decoder(v)
        return "".join(decoder.feed(found[at : at + step]) for at in range(0, len(found or ()), step)) + decoder.finish()

    return _over_texts(df, keep, ids, out, "string", lambda v, lists: pa.array([text_of(v, x) for x in lists], pa.string()), vocabulary)


def p8_ids(spark, d: str) -> DataFrame:
    """The token ids of every document: doc_id, ids."""
    return encode_texts(spark.read.parquet(f"{d}/documents.parquet"), ["doc_id"], "text")


def p8_decoded(spark, d: str) -> DataFrame:
    """Every document's text out of its ids again, null as empty: doc_id, text."""
    return decode_ids(p8_ids(spark, d), ["doc_id"], "ids")


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded}
SQL = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
