"""Benchmark decontamination by a broadcast set of test n-grams. Columns only, no Python.

A window is ``size`` consecutive words of an item, or all words of a shorter one. Its hash stands in a table that
is broadcast when its bytes are few, and joined by a shuffle when not. The places of a document whose first and last
two words are in a filter of those of all windows, of bounded size, are hashed alike and looked up; every hit
is verified word for word on the document's text before it counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import BROADCAST_BYTES
from .common import evaluated, materialise, side, unused

#: What separates words, and what words are made of (A-Z are lower-cased after).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WITHIN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Slots of the filter of word pairs at most, as a power of two.
FILTER_SLOTS = 18


def raw_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN, -1), lambda w: w != "")


def normal(word: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct (item_id, l, h, ws) of the items; ws are the window's words."""
    items = evaluated(benchmark.where("item_id is not null"), ["item_id"], ws=F.transform(raw_words(F.col("text")), normal)).where(F.size("ws") > 0)
    items = items.withColumn("l", F.least(F.size("ws"), F.lit(size))).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("l") + 1)))
    items = items.select("item_id", "l", F.slice("ws", F.col("i"), F.col("l")).alias("ws")).distinct()
    return items.withColumn("h", F.xxhash64(F.transform("ws", lambda w: F.xxhash64(w))))


def _pair(a: Column, b: Column, slots: int) -> Column:
    """The slot, from 0, of two neighbouring words' hashes in a filter."""
    return a.bitwiseXOR(F.shiftrightunsigned(b, 7)).bitwiseAND(F.lit(slots - 1)).cast("int")


def _pair_filter(windows: DataFrame, n: int) -> bytes:
    """A byte for each slot, 1 where the first or the last two words of a window fall.

    Some 16 slots a window, ``2 ** FILTER_SLOTS`` at most, so what the driver takes in is bounded. A full filter lets all pass.
    """
    slots = 1 << min(FILTER_SLOTS, max(12, (16 * n).bit_length()))
    word = lambda i: F.xxhash64(F.get("ws", i))
    ends = F.array(_pair(word(F.lit(0)), word(F.lit(1)), slots), _pair(word(F.col("l") - 2), word(F.col("l") - 1), slots))
    found = windows.where("l > 1").select(F.explode(ends).alias("k")).groupBy(F.expr("k >> 6").alias("w"))
    out = bytearray(slots)
    for w, bits in found.agg(F.expr("bit_or(shiftleft(1L, k & 63))").alias("bits")).collect():  # at most a row for 64 slots
        out[64 * w : 64 * w + 64] = bytes(bits >> k & 1 for k in range(64))
    return bytes(out)


def _windows(length: int) -> Column:
    """Place, length and hash of each window of the hashes ``hs`` whose first and last two words are in the filter (``ok``)."""
    places = f"sequence(0, size(hs) - {length})"
    if length > 1:
        places = f"filter({places}, i -> ok[i] and ok[i + {length - 2}])"
    each = f"transform({places}, i -> struct(i as p, {length} as l, xxhash64(slice(hs, i + 1, {length})) as h))"
    return F.expr(f"case when size(hs) >= {length} then {each} else cast(array() as array<struct<p:int,l:int,h:bigint>>) end")


def _scan(docs: DataFrame, windows: DataFrame, limit: int) -> DataFrame:
    """Per distinct (doc_id, tk): n_words, copies (rows), and places (p, l, h) where the hash of a window occurs."""
    table = materialise(windows.select(F.col("h").alias("bh"), F.col("l").alias("bl")).distinct())
    lengths = sorted(r[0] for r in table.select("bl").distinct().collect())  # at most ``size`` of them
    known = _pair_filter(windows, table.count())
    src = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tk"))
    src = evaluated(src, ["doc_id", "tk"], hs=F.transform(raw_words(F.col("text")), lambda w: F.xxhash64(normal(w))))
    listed = lambda i: F.substring(F.lit(known), _pair(F.get("hs", i), F.get("hs", i + 1), len(known)) + 1, 1) == F.lit(b"\1")
    src = evaluated(src, ["doc_id", "tk", "hs"], ok=F.when(F.size("hs") > 1, F.transform(F.sequence(F.lit(0), F.size("hs") - 2), listed)))
    # A row for the document itself, of a length that no window has; by its hash, so that these rows aren't of one key.
    own = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("l"), F.col("tk").alias("h")))
    at = F.explode(F.concat(own, *(_windows(x) for x in lengths))).alias("at")
    src = src.select("doc_id", "tk", F.size("hs").cast("bigint").alias("n_words"), at).select("doc_id", "tk", "n_words", "at.p", "at.l", "at.h")
    met = src.join(side(table, limit), (F.col("h") == F.col("bh")) & (F.col("l") == F.col("bl")), "left").where("bh is not null or p = -1")
    found = F.collect_set(F.when(F.col("bh").isNotNull(), F.struct("p", "l", "h")))
    return materialise(met.groupBy("doc_id", "tk").agg(F.max("n_words").alias("n_words"), F.sum(F.when(F.col("p") == -1, 1).otherwise(0)).alias("copies"), found.alias("found")))


def _verified(docs: DataFrame, scanned: DataFrame, windows: DataFrame, limit: int) -> DataFrame:
    """(doc_id, tk, p, l, h, ws): places whose words are a window's, word for word."""
    dirty = materialise(scanned.where(F.size("found") > 0).select(F.col("doc_id").alias("d"), F.col("tk").alias("t"), "found"))
    texts = docs.select("doc_id", "text").withColumn("tk", F.coalesce(F.xxhash64("text"), F.lit(0)))
    texts = texts.join(side(dirty, limit), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t"))).select("doc_id", "tk", "text", "found")
    words = evaluated(texts, ["doc_id", "tk", "found"], words=F.transform(raw_words(F.col("text")), normal))
    at = words.select("doc_id", "tk", F.explode(F.transform("found", lambda x: F.struct(x["p"].alias("p"), x["l"].alias("l"), x["h"].alias("h"), F.slice(F.col("words"), x["p"] + 1, x["l"]).alias("ws")))).alias("at"))
    at = at.select("doc_id", "tk", "at.p", "at.l", "at.h", "at.ws")
    known = materialise(windows.select(F.col("h").alias("bh"), F.col("l").alias("bl"), F.col("ws").alias("bw")).distinct())
    same = (F.col("h") == F.col("bh")) & (F.col("l") == F.col("bl")) & (F.col("ws") == F.col("bw"))
    return materialise(at.join(side(known, limit), same, "left_semi").distinct())


def _places(verified: DataFrame) -> DataFrame:
    """(doc_id, tk, at): the numbers of the words inside verified windows."""
    runs = F.collect_list(F.sequence("p", F.col("p") + F.col("l") - 1))
    return verified.groupBy("doc_id", "tk").agg(F.array_distinct(F.flatten(runs)).alias("at"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, limit: int = BROADCAST_BYTES) -> DataFrame:
    """How much of each document is covered by windows of the benchmark's items.

    Takes ``doc_id`` (any type) and ``text`` of documents, ``item_id`` and ``text`` of items; other columns are not
    read. Returns per row: ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items``
    and ``items_sha256`` (of the items with occurring windows, sorted as strings, comma-joined), ``contaminated``
    (n_hit > 0). Null and empty texts have no words; items with a null id or without words have no windows; items
    that repeat an id are one item; a null doc_id stays null; repeated rows stay repeated. Without items nothing is
    hit; without documents the result is empty. ``limit`` bounds the bytes of a table that is broadcast.

    Items meet documents only where a window of theirs is verified, once for each document and window.
    """
    windows = materialise(item_windows(benchmark, size))
    scanned = _scan(docs, windows, limit)
    verified = _verified(docs, scanned, windows, limit)
    hit = _places(verified).select(F.col("doc_id").alias("d"), F.col("tk").alias("t"), F.size("at").cast("bigint").alias("n_hit"))
    of = materialise(windows.select(F.col("item_id").cast("string").alias("item"), F.col("h").alias("bh"), F.col("l").alias("bl"), F.col("ws").alias("bw")))
    same = (F.col("h") == F.col("bh")) & (F.col("l") == F.col("bl")) & (F.col("ws") == F.col("bw"))
    items = verified.select("doc_id", "tk", "h", "l", "ws").distinct().join(side(of, limit), same).select("doc_id", "tk", "item").distinct()
    items = items.groupBy(F.col("doc_id").alias("d2"), F.col("tk").alias("t2")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    told = materialise(hit.join(items, F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2"))).select("d", "t", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256")))
    out = scanned.select("doc_id", "tk", "n_words", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    out = out.join(side(told, limit), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")), "left")
    nothing = F.sha2(F.encode(F.lit(""), "UTF-8"), 256)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.cast("bigint").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                      F.coalesce("items_sha256", nothing).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contamination: contaminated rows go (``documents``), or hit words with what follows them (``spans``).

    All columns of ``docs`` stay, of whatever name; rows are told by ``doc_id`` and text, as above.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    windows = materialise(item_windows(benchmark, size))
    found = _places(_verified(docs, _scan(docs, windows, limit), windows, limit))
    id_name, key_name, at_name = unused(docs, "hit_doc", "hit_key", "hit_at")
    found = found.select(F.col("doc_id").alias(id_name), F.col("tk").alias(key_name), F.col("at").alias(at_name))
    same = docs["doc_id"].eqNullSafe(F.col(id_name)) & (F.coalesce(F.xxhash64(docs["text"]), F.lit(0)) == F.col(key_name))
    if remove == "documents":
        return docs.join(side(materialise(found.drop(at_name)), limit), same, "left_anti")
    gaps, words = F.split(docs["text"], WITHIN, -1), raw_words(docs["text"])
    kept = F.transform(words, lambda w, i: F.when(F.array_contains(F.col(at_name), i), "").otherwise(F.concat(w, F.get(gaps, i + 1))))
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))
    out = docs.join(side(materialise(found), limit), same, "left")
    return out.select(*(F.when(F.col(at_name).isNull(), docs[c]).otherwise(cut).alias(c) if c == "text" else docs[c] for c in docs.columns))
