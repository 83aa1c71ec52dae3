"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both tables are cut into words. Of every stretch of words that a window of the benchmark
can have, the smallest hash of the k-grams in it becomes a fingerprint; a document and an
item that share a window therefore share a fingerprint, wherever the window lies. The
distinct fingerprints of the benchmark meet those of the documents in a semi-join, which
leaves few documents. In these, hits are extended: each k-gram that matched is widened to
all windows that hold it, and those are joined word by word with the windows of the items.
What comes out is exact, since hashes only choose what is compared.

Items of fewer words than ``window`` are one window each. They get fingerprints of their
own, chosen so that even the shortest of them shares one.

Nothing is collected but the different numbers of words below ``window`` that items have.
Tables made from the benchmark are written first, so that the planner broadcasts them by
their size on disk, and shuffles them otherwise; adaptive execution splits hot keys, as
each of them is on the side of the documents.

Defined results: a null or empty text has no words, no hits and is not contaminated.
Items without words count nothing. Item rows that share an id are one item; a null id is
written as an empty string. Repeated rows of documents count once, and rows that share an
id but not the text stay apart (``text_key``). Empty tables give no rows, or no hits.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fence import fence
from plumbline.llm.common import keyed, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 5
#: Contaminated from one hit word in so many on.
SHARE = 20


def words(text: str) -> Column:
    """Words of a text in lower case; only A-Z are lowered."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def families(lengths: list[int], window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int, list[int]]]:
    """(words of a k-gram, k-grams of a stretch, lengths of windows served) of each kind of fingerprint."""
    found = [(min(gram, window), max(1, window - gram + 1), [window])]
    short = sorted(n for n in lengths if n < window)
    middle = [n for n in short if n >= gram]
    if middle:
        found.append((gram, middle[0] - gram + 1, middle))
    return found + [(n, 1, [n]) for n in short if n < gram]


def gram_hashes(items: Column, k: int) -> Column:
    """Hash of the k-gram at each word; an empty array for fewer words than k."""
    starts = F.when(F.size(items) >= k, F.sequence(F.lit(1), F.size(items) - (k - 1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(items, i, F.lit(k)), F.lit(k)))


def _least_of(hashes: str, stretch: int) -> Column:
    """The smallest hash of each stretch of so many k-grams."""
    starts = F.when(F.size(hashes) >= stretch, F.sequence(F.lit(1), F.size(hashes) - (stretch - 1)))
    return F.transform(starts, lambda i: F.array_min(F.slice(hashes, i, F.lit(stretch))))


def _with_fingerprints(frame: DataFrame, kinds: list[tuple[int, int, list[int]]]) -> DataFrame:
    """Adds ``prints``. The hashes of each kind are a fenced column, so that they are made once."""
    empty = F.array().cast("array<bigint>")
    names = [f"_hashes{number}" for number in range(len(kinds))]
    hashes = {name: fence(F.coalesce(gram_hashes(F.col("words"), k), empty)) for name, (k, _, _) in zip(names, kinds, strict=True)}
    frame = frame.withColumns(hashes)
    least = [F.coalesce(_least_of(name, stretch), empty) for name, (_, stretch, _) in zip(names, kinds, strict=True)]
    return frame.withColumn("prints", F.array_distinct(F.concat(*least)))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Each different window of the benchmark with the items that have it."""
    items = benchmark.select(
        F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), fence(words("text")).alias("words")
    ).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    pieces = items.select("item", "words", length.alias("length"), F.explode(starts).alias("start"))
    text = F.array_join(F.expr("slice(words, start, length)"), " ")
    return pieces.select("item", "length", text.alias("window")).groupBy("length", "window").agg(
        F.collect_set("item").alias("items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, hit_words (places, from 0, of words in windows), item_ids (sorted), contaminated."""
    windows = written(item_windows(benchmark, window), "item-windows")
    lengths = [r[0] for r in windows.where(F.col("length") < window).select("length").distinct().collect()]
    kinds = families(lengths, window)
    benchmark_words = windows.select(F.split("window", " ").alias("words"))
    prints = written(
        _with_fingerprints(benchmark_words, kinds).select(F.explode("prints").alias("print")).distinct(), "item-prints"
    )

    texts = keyed(docs)
    split = _with_fingerprints(texts.withColumn("words", fence(words("text"))), kinds)
    ours = split.select("doc_id", "text_key", F.size("words").alias("n_words"), F.explode_outer("prints").alias("print"))
    matched = ours.join(prints.withColumn("shared", F.lit(True)), "print", "left")
    per_doc = written(
        matched.groupBy("doc_id", "text_key").agg(
            F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("shared"), F.col("print"))).alias("matched")
        ),
        "doc-prints",
    )

    chosen = per_doc.where(F.size("matched") > 0).select("doc_id", "text_key", "matched")
    on = texts["doc_id"].eqNullSafe(chosen["doc_id"]) & (texts["text_key"] == chosen["text_key"])
    near = texts.join(chosen, on).select(texts["doc_id"], texts["text_key"], "text", "matched")
    # Repeated rows give their hits more than once, which changes nothing in what is found.
    near = near.withColumn("words", fence(words("text")))
    candidates = None
    for k, _, served in kinds:
        hashed = near.withColumn("hashes", fence(gram_hashes(F.col("words"), k)))
        places = F.filter(F.sequence(F.lit(1), F.size("hashes")), lambda i: F.array_contains("matched", F.get("hashes", i - 1)))
        hashed = hashed.where(F.size("hashes") > 0).withColumn("places", fence(places))
        for length in served:
            last = F.size("words") - (length - 1)
            reach = lambda i: F.sequence(F.greatest(i - (length - k), F.lit(1)), F.least(i, last))  # noqa: B023, E731
            inside = F.filter("places", lambda i: F.greatest(i - (length - k), F.lit(1)) <= F.least(i, last))  # noqa: B023
            starts = F.array_distinct(F.flatten(F.transform(inside, reach)))
            text = F.array_join(F.slice("words", F.col("start"), F.lit(length)), " ")
            part = hashed.select("doc_id", "text_key", "words", F.explode(starts).alias("start")).select(
                "doc_id", "text_key", "start", F.lit(length).alias("length"), text.alias("window")
            )
            candidates = part if candidates is None else candidates.unionByName(part)

    hits = candidates.join(windows, ["length", "window"])
    covered = F.flatten(F.collect_list(F.sequence(F.col("start") - 1, F.col("start") + F.col("length") - 2)))
    found = hits.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.array_distinct(covered)).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "hit_words", "item_ids")
    same = per_doc["doc_id"].eqNullSafe(F.col("_id")) & (per_doc["text_key"] == F.col("_key"))
    n_hit = F.coalesce(F.size("hit_words"), F.lit(0))
    return per_doc.join(found, same, "left").select(
        "doc_id",
        "text_key",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.when(F.col("hit_words").isNull(), False).otherwise((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )
