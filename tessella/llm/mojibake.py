"""Garbled text from wrong character encodings: found by character-pair statistics, restored by inverse mappings.

Three steps over the whole corpus. Pairs of adjacent characters are counted into a table of fixed size. Each
text's pairs are then scored by mutual information, and the maximum-scoring segments of improbable pairs, widened
to the words that hold them, are its runs. Inverse mappings are tried inside those runs alone, and one is taken where
the restored run is likelier, under the same counts, than the run as it stands. In a text that is garbled in a run, less
improbable runs are looked at as well.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the hashed tables of pairs and of single characters; the counts' size is bounded by them, not by the corpus.
PAIRS, SINGLES = 1 << 21, 1 << 16
#: Bits of squared mutual information under which a pair is improbable: at first, and in a text that is garbled in one of its runs.
IMPROBABLE, DOUBTFUL = -13.0, -9.0
#: Bits by which a restored text must be likelier: where the bytes are valid UTF-8, and where only one table was taken for another.
MARGIN_UTF8, MARGIN_TABLE = 2.0, 8.0
#: Cases that a character's own share in the corpus counts for among those of what precedes it.
UNSURE = 64
#: Tables by which UTF-8 is read wrongly.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "cp1254", "cp1253", "cp866", "koi8-r", "cp1257", "cp852", "cp775")
#: Fixed values: (table read, table meant) of single-byte confusions.
CONFUSED = (
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"),
    ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp866"), ("cp437", "cp866"), ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp1252", "iso8859-2"), ("iso8859-2", "cp1252"), ("cp852", "cp1250"), ("cp1250", "cp852"), ("cp850", "cp852"), ("cp1252", "iso8859-5"), ("mac_roman", "cp1250"),
)
#: Entries that a process remembers of what it computed for words; they are computed again beyond that.
MEMO = 200_000
#: Times one text may have been garbled over again.
DEPTH = 3

_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7});")


def _table(name: str) -> tuple[dict[str, int], list[str]]:
    """Character to byte and back; bytes that a table leaves open stand for the control character of that number."""
    back = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
    return {c: b for b, c in enumerate(back)}, back


_TABLES = {name: _table(name) for name in {*READ_AS, *(x for pair in CONFUSED for x in pair)}}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - 21)).astype(np.int64)


def _single_keys(a: np.ndarray) -> np.ndarray:
    return np.where(a < 0xFFFF, a, 0xFFFF).astype(np.int64)


def pair_counts(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """How often each hashed pair of adjacent characters, and each character, occurs in all texts.

    Every task adds up its own table and gives the filled places; they are added up again after the shuffle,
    and at most ``PAIRS`` + ``SINGLES`` numbers reach the driver, whatever the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, singles = np.zeros(PAIRS, np.int64), np.zeros(SINGLES, np.int64)
        for b in batches:
            for at in range(0, len(b), 256):
                codes = _codes("\n".join(t for t in b.iloc[at : at + 256, 0] if t))
                if len(codes):
                    singles += np.bincount(_single_keys(codes), minlength=SINGLES)
                    keys, n = np.unique(_pair_keys(codes[:-1], codes[1:]), return_counts=True)
                    pairs[keys] += n
        for table, base in ((pairs, 0), (singles, PAIRS)):
            filled = np.flatnonzero(table)
            yield pd.DataFrame({"key": (filled + base).astype(np.int32), "n": table[filled]})

    rows = df.select(text).mapInPandas(count, "key int, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    every = np.zeros(PAIRS + SINGLES, np.int64)
    every[rows["key"].to_numpy()] = rows["n"].to_numpy()
    return every[:PAIRS], every[PAIRS:]


class Model:
    """Likelihoods under the counts of a corpus."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray) -> None:
        total = max(1, int(singles.sum()))
        self._pairs, self._singles, self._total = pairs, singles, total
        # what the corpus lacks is unlikely, not impossible
        # a pair seen once is no sign that its characters belong together
        self.pair = np.log2((np.maximum(pairs - 1, 0) + 0.25) / total).astype(np.float32)
        self.single = np.log2((singles + 1.0) / total).astype(np.float32)
        self._bits: dict[str, float] = {}
        self.utf8: dict[str, str | None] = {}
        self.gains: dict[str, np.ndarray] = {}

    def improbable(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Of each pair, the bits by which its squared mutual information, log p(ab)^2 / p(a) p(b), is under ``least``."""
        return least - (2 * self.pair[_pair_keys(a, b)] - self.single[_single_keys(a)] - self.single[_single_keys(b)])

    def bits(self, two: str) -> float:
        """log p of the second character after the first; what follows a rare one is as likely as it is anywhere."""
        found = self._bits.get(two)
        if found is None:
            codes = _codes(two)
            after = (self._singles[_single_keys(codes[1:])[0]] + 0.5) / self._total
            n = self._pairs[_pair_keys(codes[:1], codes[1:])[0]] + UNSURE * after
            if len(self._bits) > MEMO:
                self._bits.clear()
            found = self._bits[two] = math.log2(n / (self._singles[_single_keys(codes[:1])[0]] + UNSURE))
        return found

    def likelihood(self, text: str) -> float:
        """Bits of log p of a text, given its first character."""
        return sum(self.bits(text[i : i + 2]) for i in range(len(text) - 1))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments [from, to) of a sequence, in time linear in it."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    # neighbouring positive scores always share a segment
    starts = positive[np.concatenate(([True], np.diff(positive) > 1))]
    ends = positive[np.concatenate((np.diff(positive) > 1, [True]))] + 1
    done: list[tuple[int, int]] = []
    stack: list[tuple[int, int, float, float]] = []  # from, to, sum before, sum at the end
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        item = (s, e, sums[s], sums[e])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j -= 1
            if j < 0:  # nothing to come can reach behind this one
                done += [(a, b) for a, b, _, _ in stack]
                stack = [item]
                break
            if stack[j][3] >= item[3]:
                stack.append(item)
                break
            item = (stack[j][0], item[1], stack[j][2], item[3])
            del stack[j:]
    return done + [(a, b) for a, b, _, _ in stack]


def improbable_runs(text: str, model: Model, least: float = IMPROBABLE) -> list[tuple[int, int]]:
    """The words with characters beyond ASCII of a text in which its maximal segments of improbable pairs lie, by itself."""
    codes = _codes(f"\n{text}\n")
    high = np.flatnonzero(codes > 127)
    if not len(high):
        return []
    gaps = np.flatnonzero((codes == 32) | (codes == 10) | (codes == 13) | (codes == 9) | (codes == 0x3000))
    word = np.unique(np.searchsorted(gaps, high))
    starts, ends = gaps[word - 1] + 1, gaps[word]
    # the pairs of these words, from the space before to the space behind, one word after the other
    sizes = ends - starts + 1
    first = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(first[-1]) - np.repeat(first[:-1] - starts + 1, sizes)
    segments = maximal_segments(model.improbable(codes[at], codes[at + 1], least))
    if not segments:
        return []
    seg = np.array(segments)
    k = np.searchsorted(seg[:, 1], first[:-1], side="right")  # the first segment that ends in the word or later
    touched = (k < len(seg)) & (seg[np.minimum(k, len(seg) - 1), 0] < first[1:])
    return [(s - 1, e - 1) for s, e in zip(starts[touched].tolist(), ends[touched].tolist(), strict=True)]


def _as_utf8(run: str, table: str) -> str | None:
    """The run with those characters that are UTF-8 read by ``table`` as what they were; null where none are."""
    to_byte = _TABLES[table][0]
    data = [to_byte.get(c, 0) for c in run]
    out, at, i = [], 0, 0
    while i < len(data):
        b = data[i]
        n = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if n:
            try:
                c = bytes(data[i : i + n]).decode("utf-8")
            except UnicodeDecodeError:
                c = ""
            if len(c) == 1:
                out += [run[at:i], c]
                i = at = i + n
                continue
        i += 1
    return "".join(out) + run[at:] if out else None


def _as_table(run: str, read: str, meant: str) -> str | None:
    """The run as ``meant`` gives the bytes that ``read`` gave; null where ``read`` lacks a character or ``meant`` leaves the byte open."""
    to_byte, back = _TABLES[read][0], _TABLES[meant][1]
    out = []
    for c in run:
        if c > "\x7f":
            c = back[to_byte.get(c, 0x7F)]
            if c < "\xa0":
                return None
        out.append(c)
    made = "".join(out)
    return made if made != run else None


def _openings() -> dict[str, tuple[str, ...]]:
    """Two characters that begin a UTF-8 character under some tables, and those tables."""
    found: dict[str, list[str]] = {}
    for t in READ_AS:
        back = _TABLES[t][1]
        for lead in range(0xC2, 0xF5):
            for after in range(0x80, 0xC0):
                found.setdefault(back[lead] + back[after], []).append(t)
    return {k: tuple(v) for k, v in found.items()}


_OPENINGS = _openings()


def _readings(run: str) -> set[str]:
    """What the run may have been, by every table under which some of it is UTF-8."""
    tables = {t for a, b in zip(run, run[1:], strict=False) if b > "\x7f" and (at := _OPENINGS.get(a + b)) for t in at}
    return {x for t in tables if (x := _as_utf8(run, t))}


def restored_utf8(run: str, model: Model) -> str | None:
    """The likeliest reading of the run's characters as UTF-8 that tables misread, up to ``DEPTH`` times; null where it isn't likelier than the run."""
    if run in model.utf8:
        return model.utf8[run]
    best, todo, tried = None, {run}, set()
    for _ in range(DEPTH):
        todo = {x for r in todo for x in _readings(r)} - tried
        tried |= todo
    if tried:
        score, pick = max((model.likelihood(f" {x} "), x) for x in tried)
        best = pick if score > model.likelihood(f" {run} ") + MARGIN_UTF8 else None
    if len(model.utf8) > MEMO:
        model.utf8.clear()
    model.utf8[run] = best
    return best


_HIGH = re.compile(r"[^\x00-\x7f]+")
_KNOWN = frozenset(c for read, _ in CONFUSED for c in _TABLES[read][0])


def _stretch_gains(around: str, capitals: bool, model: Model) -> np.ndarray:
    """For each confusion, the bits gained by undoing it in characters beyond ASCII and one on either side; -inf where it can't be."""
    key = around + "\n" * capitals
    found = model.gains.get(key)
    if found is None:
        found = np.full(len(CONFUSED), -np.inf)
        if _KNOWN.issuperset(around[1:-1]):
            case = str.lower if capitals else str
            was = model.likelihood(case(around))
            for m, (read, meant) in enumerate(CONFUSED):
                x = _as_table(around, read, meant)
                if x:
                    found[m] = model.likelihood(case(x)) - was
        if len(model.gains) > MEMO:
            model.gains.clear()
        model.gains[key] = found
    return found


def table_gains(run: str, model: Model) -> np.ndarray:
    """For each confusion of two tables, the bits gained by undoing it in the run; 0 where it gains none."""
    if not any(c.isalnum() for c in run):  # lines and boxes drawn between spaces say nothing
        return np.zeros(len(CONFUSED))
    padded = f" {run} "
    capitals = run.upper() == run and sum("A" <= c <= "Z" for c in run) > 1
    total = sum(_stretch_gains(padded[m.start() - 1 : m.end() + 1], capitals, model) for m in _HIGH.finditer(padded))
    return np.maximum(total, 0.0)


def restored(text: str, runs: list[tuple[int, int]], model: Model) -> tuple[bool, str]:
    """Whether a text is garbled in one of its runs, and the text with all runs restored that can be."""
    picks = [restored_utf8(text[s:e], model) for s, e in runs]
    if not any(picks) and runs:
        # one table taken for another holds for a whole text: the gains of its different runs are added up
        totals = sum(table_gains(x, model) for x in {text[s:e] for s, e in runs})
        m = int(np.argmax(totals))
        if totals[m] > MARGIN_TABLE:
            picks = [_as_table(text[s:e], *CONFUSED[m]) if table_gains(text[s:e], model)[m] > 0 else None for s, e in runs]
    out, at = [], 0
    for (s, e), x in zip(runs, picks, strict=True):
        if x:
            out += [text[at:s], x]
            at = e
    made = "".join(out) + text[at:]
    return made != text or any("\ufffd" in text[s:e] for s, e in runs), made


def _unescaped(text: str) -> str:
    """Entities of characters beyond ASCII written out, as they stand inside garbled text."""
    return _ENTITY.sub(lambda m: c if len(c := html.unescape(m.group())) == 1 and c > "\x7f" else m.group(), text)


def restore_text(text: str, model: Model) -> tuple[bool, str]:
    """``restored`` of a text by its improbable runs, and, if it is garbled in one, by its doubtful ones too.

    Where entities stand in it, it is that of the text with them written out, if it is garbled then.
    """
    for x in (_unescaped(text), text) if "&" in text else (text,):
        garbled, made = restored(x, improbable_runs(x, model), model)
        if garbled and (x == text or made != x):
            again = restored(x, improbable_runs(x, model, DOUBTFUL), model)
            return True, again[1] if again[0] else made
    return False, text


def find_garbled(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep``, ``restored`` of the rows whose text is garbled anywhere.

    ``restored`` is the text with all that could be restored; null where nothing could (its characters are
    lost). Null, empty and pure ASCII texts are never garbled. Whole texts are read, whatever their length;
    repeated rows each have their row. Nothing is shuffled but the pair counts.
    """
    tables = df.sparkSession.sparkContext.broadcast(pair_counts(df, text))
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*tables.value)
        for b in batches:
            found = [restore_text(t, model) for t in b[text]]
            garbled = [i for i, (g, _) in enumerate(found) if g]
            out = b.iloc[garbled][keep].copy()
            out["restored"] = pd.Series([found[i][1] if found[i][1] != b[text].iloc[i] else None for i in garbled], index=out.index, dtype=object)
            yield out

    maybe = F.col(text).rlike(r"[^\x00-\x7F]|&[A-Za-z#]")
    return df.select(*keep, text).where(maybe).mapInPandas(run, fields + ", restored string")


def p10_found(spark, d: str) -> DataFrame:
    """The documents garbled anywhere: doc_id."""
    return find_garbled(spark.read.parquet(f"{d}/documents.parquet"), ["doc_id"], "text").select("doc_id")


def p10_restored(spark, d: str) -> DataFrame:
    """The same with their restored texts: doc_id, restored."""
    return find_garbled(spark.read.parquet(f"{d}/documents.parquet"), ["doc_id"], "text")


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
SQL: dict[str, str] = {}
