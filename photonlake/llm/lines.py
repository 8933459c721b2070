"""Line dedup by winnowing over word grams.

Of each window of ``min_run`` consecutive words, wherever lines end, the least hash of the grams inside it (half as
long as the window; of equal ones the last) is its fingerprint, which depends on the window's words alone. The
windows next to each other that share one fingerprint are a stretch. A stretch that occurs earlier with the same
words is deleted whole; where a fingerprint occurs in several different stretches, at the ends of copies and in stock
sentences, each window of these is looked up by itself. So a word is deleted exactly if a window of ``min_run`` words
around it occurs earlier, whatever else its parts occur in, and the first occurrence of everything stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_utf8, materialise, mix64, side, slices, span_hashes, split_words

#: Words of a run at least.
MIN_RUN = 32
#: Text bytes in which equal stretches are matched before anything is shuffled, so a hot one is sent once for each.
LOCAL_BYTES = 8 << 20
#: Text bytes whose words are hashed at a time, and whose windows are looked up.
HASHED_BYTES = 1 << 20
#: Odd multiplier of the rolling hash, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of texts laid end to end, with a hash of any run of them."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        apart, begin, end, self.owner = split_words(data, at)
        self.first = np.searchsorted(self.owner, np.arange(len(at)))
        n = len(begin)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(span_hashes(apart, begin, end) * _powers(_BASE, n), out=self.sums[1:])
            self.back = _powers(_BACK, n)

    def hashes(self, place: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[place + size] - self.sums[place]) * self.back[place] + np.asarray(size).astype(np.uint64))


def stretches(words: Words, run: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a fingerprint: its hash, that of the stretch, text, first word in it, and number of windows."""
    n, gram = len(words.owner), max(1, run // 2)
    count = n - run + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    best, where = words.hashes(np.arange(n - gram + 1), gram), np.arange(n - gram + 1)
    grams, width, most = best, 1, run - gram + 1
    while width < most:
        step = min(width, most - width)
        right = best[step:] <= best[:-step]
        best, where = np.where(right, best[step:], best[:-step]), np.where(right, where[step:], where[:-step])
        width += step
    inside = words.owner[:count] == words.owner[run - 1 :]
    new = np.ones(count, bool)
    new[1:] = (where[1:] != where[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new)
    windows = np.diff(np.append(starts, count))
    # Places where no window of one text starts follow a text's last window, and aren't new ones there.
    lost = np.add.reduceat((~inside).astype(np.int64), starts)
    windows = windows - lost
    starts, windows = starts[windows > 0], windows[windows > 0]
    text = words.owner[starts]
    with np.errstate(over="ignore"):
        whole = mix64(words.hashes(starts, windows + run - 1) + (where[starts] - starts).astype(np.uint64))
    return grams[where[starts]].view(np.int64), whole.view(np.int64), text, starts - words.first[text], windows


def _changes(*cols: np.ndarray) -> np.ndarray:
    """Where a row, in order, differs from the one before."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = False
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def _repeats(first: np.ndarray, doc: np.ndarray, text: np.ndarray, word: np.ndarray, run: int) -> np.ndarray:
    """Rows, in order, that repeat the first row of their key: of another document, or so far on that windows don't overlap."""
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, int)
    return (doc != doc[lead]) | (text != text[lead]) | (word - word[lead] >= run)


def _sorted(cols: list[np.ndarray], keys: int) -> list[np.ndarray]:
    order = np.lexsort(cols[:keys][::-1])
    return [c[order] for c in cols]


def _groups(h: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each row, in order of h, whether a row of the same h is marked."""
    first = _changes(h)
    return np.logical_or.reduceat(marks, np.flatnonzero(first))[np.cumsum(first) - 1] if len(h) else marks


def _batch(names: list[str], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate([np.asarray(p[k], np.int64) for p in parts]) for k in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{x}` bigint" for x in names)


#: Rows of a stretch are asked about (ASK), or known to have others (TOLD); or say what is found: to delete (DONE), to look at by windows (TEST).
ASK, TOLD, DONE, TEST = range(4)
#: A document is a doc_id and, where that has several texts, the text's hash. A place is a word's number in the text with
#: a number of windows and a kind in its lowest bits, so that rows are narrow and are ordered by word.
_ROWS = ["h", "whole", "doc", "text", "place"]
_FOUND = ["doc", "text", "place"]
_WINDOWS = ["h", "doc", "text", "place"]
_KIND_BITS, _WINDOW_BITS = 2, 16


def _place(word: np.ndarray, windows, kind) -> np.ndarray:
    return (np.asarray(word, np.int64) << (_KIND_BITS + _WINDOW_BITS)) | (np.asarray(windows, np.int64) << _KIND_BITS) | kind


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, windows and kind of places."""
    return place >> (_KIND_BITS + _WINDOW_BITS), (place >> _KIND_BITS) & ((1 << _WINDOW_BITS) - 1), place & ((1 << _KIND_BITS) - 1)


def _spread(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(np.asarray(doc, np.int64).view(np.uint64) + np.asarray(word, np.int64).view(np.uint64)).view(np.int64)


def _told_apart(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(doc, text_key, text, rest0, ...): the key is the text's hash where a doc_id has several texts, else 0."""
    key = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    src = docs.select(docs["doc_id"].alias("doc"), key.alias("text_key"), docs["text"].alias("text"), *(docs[c].alias(f"rest{i}") for i, c in enumerate(keep)))
    several = src.where("doc is not null").groupBy("doc").agg((F.min("text_key") < F.max("text_key")).alias("several")).where("several")
    several = materialise(several.select(F.col("doc").alias("of")))
    if several.isEmpty():
        return src.withColumn("text_key", F.lit(0).cast("bigint"))
    met = src.join(side(several), F.col("doc") == F.col("of"), "left")
    return met.withColumn("text_key", F.when(F.col("of").isNotNull(), F.col("text_key")).otherwise(F.lit(0).cast("bigint"))).drop("of")


def _scan(src: DataFrame, run: int) -> DataFrame:
    """Stretches, those of one fingerprint in a piece of the input as one row, and what a piece shows by itself."""

    def scan(batches):
        for batch in batches:
            for piece in slices(batch, "text", LOCAL_BYTES):
                parts, base = [], 0
                ids, keys = (piece.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                for small in slices(piece, "text", HASHED_BYTES):
                    h, whole, row, word, windows = stretches(Words(*flat_utf8(small.column(2))), run)
                    parts.append((h, whole, ids[base + row], keys[base + row], word, windows))
                    base += small.num_rows
                h, whole, doc, text, word, windows = _sorted([np.concatenate([p[k] for p in parts]) for k in range(6)], 5)
                first = _changes(h, whole)
                done = _repeats(first, doc, text, word, run)
                several = _groups(h, first & ~_changes(h))
                ask, told, test = ~several & ~done, several & _changes(h), several & ~done
                out = [[h[k], whole[k], doc[k], text[k], _place(word[k], windows[k], kind)] for k, kind in ((ask, ASK), (told, TOLD))]
                out += [[_spread(doc[k], word[k]), np.zeros(int(k.sum())), doc[k], text[k], _place(word[k], windows[k], kind)] for k, kind in ((done, DONE), (test, TEST))]
                yield _batch(_ROWS, out)

    src = src.where("doc is not null and text is not null").select(F.col("doc").cast("bigint"), "text_key", "text")
    return src.mapInArrow(scan, _ddl(_ROWS))


def _compared(rows: DataFrame, run: int) -> DataFrame:
    """(doc, text, place): stretches to delete, and those whose windows occur in other stretches too."""

    def compared(cols):
        h, whole, doc, text, place = cols
        word, windows, kind = _unpacked(place)
        first = _changes(h, whole)
        several = _groups(h, (first & ~_changes(h)) | (kind == TOLD))
        done = _repeats(first, doc, text, word, run) & (kind == ASK)
        test = several & ~done & (kind == ASK)
        return [[doc[k], text[k], _place(word[k], windows[k], what)] for k, what in ((done, DONE), (test, TEST))]

    def compare(batches):
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            known = _unpacked(cols[4])[2] >= DONE
            out = [[c[known] for c in cols[2:]]]
            cols = [c[~known] for c in cols]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            if len(cols[0]):  # the last fingerprint may go on: a row or a few for each piece of the input
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                out += compared([c[:cut] for c in cols])
                held = [c[cut:] for c in cols]
            yield _batch(_FOUND, out)
        if held is not None:
            yield _batch(_FOUND, compared(held))

    return rows.repartition("h").sortWithinPartitions("h", "whole", "doc", "text", "place").mapInArrow(compare, _ddl(_FOUND))


def _by_window(left: DataFrame, found: DataFrame, run: int) -> DataFrame:
    """Rows (h, doc, text, place): a window of a stretch to test, which says no windows, or windows to delete.

    ``left`` goes through the join with all its columns and rows, so that the shuffle of the texts is the one that
    :func:`dedup_lines` reads again.
    """
    test = F.max(F.col("place").bitwiseAND(F.lit((1 << _KIND_BITS) - 1)) == TEST)
    lists = found.groupBy(F.col("doc").alias("of"), F.col("text").alias("of_key")).agg(F.collect_set("place").alias("found"), test.alias("test"))
    rest = [c for c in left.columns if c.startswith("rest")]
    text = F.when(F.col("test"), F.col("text")).otherwise("").alias("text")
    joined = left.join(lists, _own(left), "left").select(F.coalesce("of", F.lit(0)).alias("of"), F.coalesce("of_key", F.lit(0)).alias("of_key"), text, "found", *rest)

    def look(batches):
        for batch in batches:
            for piece in slices(batch, "text", HASHED_BYTES):
                lists, ids, keys = piece.column(3), piece.column(0).to_numpy(), piece.column(1).to_numpy()
                flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                word, windows, kind = _unpacked(flat.to_numpy(zero_copy_only=False))
                k = kind == DONE
                done = [_spread(ids[row[k]], word[k]), ids[row[k]], keys[row[k]], _place(word[k], windows[k], 0)]
                row, word, windows = row[~k], word[~k], windows[~k]
                words = Words(*flat_utf8(piece.column(2)))
                inside = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
                row, word = np.repeat(row, windows), np.repeat(word, windows) + inside
                h = words.hashes(words.first[row] + word, run).view(np.int64)
                h, doc, text, word = _sorted([h, ids[row], keys[row], word], 4)
                again = _repeats(_changes(h), doc, text, word, run)
                found = [_spread(doc[again], word[again]), doc[again], text[again], _place(word[again], 1, 0)]
                yield _batch(_WINDOWS, [[h[~again], doc[~again], text[~again], _place(word[~again], 0, 0)], done, found])

    return joined.mapInArrow(look, _ddl(_WINDOWS))


def _own(left: DataFrame):
    return (F.col("doc") == F.col("of")) & (F.col("text_key") == F.col("of_key"))


def repeated_spans(left: DataFrame, run: int = MIN_RUN) -> DataFrame:
    """(doc, text, place): windows, or several next to each other, that occur earlier by document and place."""

    def spans(batches):
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            word, windows, _ = _unpacked(cols[3])
            cols = [*cols[:3], word, windows]
            known = windows > 0
            out = [[c[known] for c in cols[1:]]]
            cols = [c[~known] for c in cols]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            if len(cols[0]):
                first = _changes(cols[0])
                again = _repeats(first, *cols[1:4], run)
                out.append([*(c[again] for c in cols[1:4]), np.ones(int(again.sum()))])
                held = [c[np.flatnonzero(first)[-1] :][:1] for c in cols]  # the first of the window that may go on
            doc, text, word, windows = (np.concatenate([np.asarray(o[k], np.int64) for o in out]) for k in range(4))
            yield _batch(_FOUND, [[doc, text, _place(word, windows, 0)]])

    rows = _by_window(left, _compared(_scan(left, run), run), run)
    return rows.repartition("h").sortWithinPartitions("h", "doc", "text", "place").mapInArrow(spans, _ddl(_FOUND))


def merged_runs(begin: np.ndarray, end: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Matches that overlap or touch become runs; those of at least so many words."""
    order = np.argsort(begin, kind="stable")
    out, a, b = [], None, None
    for x, y in zip(begin[order].tolist(), end[order].tolist(), strict=True):
        if a is None or x > b:
            if a is not None and b - a >= least:
                out.append((a, b))
            a, b = x, y
        else:
            b = max(b, y)
    if a is not None and b - a >= least:
        out.append((a, b))
    return out


def cut_words(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without these runs of words and the white space after each; and its number of words before."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    _, begin, _, _ = split_words(data, np.array([0, len(data)]))
    begin = begin - 1  # split_words puts a space before the text
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at : int(begin[a])] if a < len(begin) else b"")
        at = int(begin[b]) if b < len(begin) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode(), len(begin)


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, keep: tuple[str, ...] = ()) -> DataFrame:
    """Delete later occurrences of runs of at least ``min_run`` words that occur earlier.

    Takes ``doc_id`` (an integer) and ``text``; of other columns only those in ``keep`` are read. Returns per row
    ``doc_id``, ``text``, ``n_runs`` and ``n_deleted`` (words), and the columns to keep as they are; if one of these
    has a new column's name, the new one has underscores before it (see :func:`new_names`). "Earlier" is by doc_id,
    then by place in the text, so a run that a text repeats within itself is deleted there as well. Rows that are equal
    in doc_id and text are one document and don't count as each other's repetitions; other rows that repeat a doc_id
    are documents of their own, in an order that depends on their texts alone. A null id takes no part and keeps its
    text; a null text stays null; empty texts stay empty; a text that is all repetition becomes empty. An empty table
    gives an empty result.

    One shuffle carries narrow rows of stretches, a few for each fingerprint and piece of input: how often a line
    occurs changes nothing there. A second brings those that aren't settled to their texts, a third carries their
    windows, and a fourth brings a document's runs to its text.
    """
    if not 0 < min_run < 1 << _WINDOW_BITS:
        raise ValueError("min_run is a number of words")
    # A merge join whatever the sizes, so the texts are shuffled once for both joins.
    left = _told_apart(docs, list(keep)).hint("merge")
    spans = repeated_spans(left, min_run).groupBy(F.col("doc").alias("of"), F.col("text").alias("of_key")).agg(F.collect_set("place").alias("spans"))
    rest = [c for c in left.columns if c.startswith("rest")]
    joined = left.join(spans, _own(left), "left").select("doc", "text", "spans", *rest)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    names = ["doc_id", "text", *new_names(keep), *keep]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, [docs.schema["doc_id"].dataType.simpleString(), "string", "bigint", "bigint", *kinds], strict=True))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                texts, n_runs, n_deleted = piece.column(1), [0] * piece.num_rows, [0] * piece.num_rows
                marked = np.flatnonzero(piece.column(2).is_valid().to_numpy(zero_copy_only=False))
                if len(marked):
                    plain = texts.to_pylist()
                    for i in marked:
                        word, windows, _ = _unpacked(piece.column(2)[int(i)].values.to_numpy())
                        runs = merged_runs(word, word + windows + min_run - 1, min_run)
                        if runs and plain[i] is not None:
                            plain[i], _ = cut_words(plain[i], runs)
                            n_runs[i], n_deleted[i] = len(runs), sum(b - a for a, b in runs)
                    texts = pa.array(plain, pa.string())
                cols = [piece.column(0), texts, pa.array(n_runs, pa.int64()), pa.array(n_deleted, pa.int64()), *piece.columns[3:]]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, schema)


def new_names(keep: tuple[str, ...] = ()) -> list[str]:
    """The names that ``n_runs`` and ``n_deleted`` have beside columns to keep."""
    taken, out = {c.lower() for c in keep}, []
    for name in ("n_runs", "n_deleted"):
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out
