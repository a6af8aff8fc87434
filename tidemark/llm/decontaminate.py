"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters and digits (any character from U+0080 on counts as one), A-Z lower-cased. A benchmark
item's windows are its runs of WINDOW consecutive words, or its whole text where it has fewer. A document word inside
any occurrence of a window is hit.

The benchmark's grams are a hash set of short word n-grams that every window contains, taken at all offsets; a
document is probed only at every STEP-th word, with STEP so chosen that no window can fall between two probes. A probe
that is in the set brings the words around it along; the windows in them are then compared with the benchmark's word
for word. So texts are read once and never shuffled. The hash set is broadcast while it has at most
BROADCAST_GRAMS entries (8 bytes each); beyond that the probes are shuffled, without words, and joined back by row.

Cases: null or empty texts, and texts without words, have no words and no hits; a null item text has no windows;
windows of equal words belong to all their items; repeated rows each get a row with the same result; a null doc_id is
kept; an empty benchmark hits nothing; an empty documents table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, if_few, lasting, without

WINDOW = 10
BROADCAST_GRAMS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item, words, win, n): each distinct window of each item, joined by spaces, and its number of words."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), _words(text_col).alias("w")).where("size(w) > 0")
    items = items.withColumn("n", F.least(F.size("w"), F.lit(size)))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1))
    cut = items.select("item", "w", "n", starts.alias("s")).select("item", "n", F.slice("w", F.col("s"), F.col("n")).alias("words"))
    return cut.select("item", "n", "words", F.array_join("words", " ").alias("win")).distinct()


def hits(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """Rows (id, key, start, n, item): each occurrence of a window of an item in a document, start counted from 0.

    key is a hash of the row's text, which tells rows with one id apart.
    """
    found = _scan(docs, benchmark, size, id_col, text_col, broadcast_grams, False)
    return found.where("item IS NOT NULL").select("id", "key", "start", "n", "item").distinct()


def _scan(docs: DataFrame, benchmark: DataFrame, size: int, id_col: str, text_col: str, broadcast_grams: int, counts: bool) -> DataFrame:
    """Rows (id, key, start, n, item, n_words): the occurrences, with n_words null; and with `counts` a row for each row of
    docs with its number of words, and item null. The texts are split into words once where the grams are broadcast."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), _words(text_col).alias("w"))
    words = F.size(_words(text_col)).cast("long").alias("n_words")
    place = [F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("item")]
    counted = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), *place, words)
    wins = lasting(windows(benchmark, size))
    lengths = sorted(r.n for r in wins.select("n").distinct().collect())  # at most `size` numbers
    if not lengths:
        return counted if counts else counted.where("false")
    least, most = lengths[0], lengths[-1]
    gram = (least + 1) // 2
    step = least - gram + 1
    offsets = F.explode(F.sequence(F.lit(1), F.size("words") - gram + 1))
    grams = wins.select("words", offsets.alias("s")).select(F.xxhash64(F.slice("words", F.col("s"), gram)).alias("h")).distinct()
    few = grams.limit(broadcast_grams + 1).count() <= broadcast_grams
    places = F.when(F.size("w") >= gram, F.sequence(F.lit(0), F.size("w") - gram, F.lit(step))).otherwise(F.array().cast("array<int>"))
    probes = F.transform(places, lambda i: F.xxhash64(F.slice("w", i + 1, F.lit(gram))))
    if few:
        # One probe more, without a hash, stands for the row itself. The outer kind of explode: a filter on the array's size
        # would be pushed below and split the text again for every probe.
        if counts:
            probes = F.concat(probes, F.array(F.lit(None).cast("long")))
        probed = rows.withColumn("probes", probes).select("id", "key", "w", F.posexplode_outer("probes").alias("k", "h"))
        if counts:
            found = probed.join(F.broadcast(grams.withColumn("in", F.lit(True))), "h", "left").where("in OR h IS NULL")
        else:
            found = probed.join(F.broadcast(grams), "h", "left_semi")
        found = found.select("id", "key", "w", F.when(F.col("h").isNotNull(), F.col("k")).alias("k"))
    else:
        at = rows.withColumn("probes", probes).select("id", "key", F.posexplode_outer("probes").alias("k", "h")).join(grams, "h", "left_semi")
        at = at.groupBy("id", "key").agg(F.collect_set("k").alias("ks")).select(F.col("id").alias("i"), F.col("key").alias("j"), "ks")
        found = rows.join(at, (F.col("key") == F.col("j")) & F.col("id").eqNullSafe(F.col("i")))
        found = found.select("id", "key", "w", F.explode("ks").alias("k"))
    at, n = F.col("k") * step, F.size("w")
    base = F.greatest(at + gram - most, F.lit(0))
    number = F.when(F.col("k").isNull(), n.cast("long")).alias("n_words")
    part = F.when(F.col("k").isNotNull(), F.slice("w", base + 1, most * 2 - gram))
    near = found.select("id", "key", number, (at - base).alias("at"), base.alias("base"), part.alias("w"))

    def of_length(m: int) -> Column:
        first, last = F.greatest(F.col("at") + gram - m, F.lit(0)), F.least(F.col("at"), n - m)
        starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        win = lambda s: F.array_join(F.slice("w", s + 1, F.lit(m)), " ")
        return F.transform(starts, lambda s: F.struct((s + F.col("base")).alias("start"), win(s).alias("win"), F.lit(m).alias("n")))

    spans = F.when(F.col("at").isNotNull(), F.flatten(F.array(*[of_length(m) for m in lengths])))
    cut = near.select("id", "key", "n_words", F.explode_outer(spans).alias("x")).select("id", "key", "n_words", "x.start", "x.n", "x.win")
    all_keys = wins.select("item", "win")
    keys = if_few(all_keys, weight=F.octet_length("item") + F.octet_length("win") + 16)
    names = ["id", "key", "start", "n", "item", "n_words"]
    if not (few and counts):
        found = cut.where("win IS NOT NULL").join(keys, "win").select(*names)
        return found.unionByName(counted) if counts else found
    if keys is not all_keys:
        return cut.join(keys, "win", "left").where("item IS NOT NULL OR n_words IS NOT NULL").select(*names)
    # Rows of the documents themselves have no window, and would all meet in one task of a join by it.
    cut = lasting(cut)
    own = cut.where("n_words IS NOT NULL").withColumn("item", F.lit(None).cast("string"))
    return own.select(*names).unionByName(cut.where("win IS NOT NULL").join(keys, "win").select(*names))


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids of the items found), spans (start and number of
    words of each window's occurrence), contaminated."""
    scanned = lasting(_scan(docs, benchmark, size, id_col, text_col, broadcast_grams, True))
    by_row = scanned.where("item IS NOT NULL").groupBy(F.col("id").alias("i"), F.col("key").alias("j")).agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans")
    )
    covered = F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    by_row = by_row.withColumn("n_hit", F.size(F.array_distinct(covered)).cast("long"))
    rows = scanned.where("n_words IS NOT NULL").select("id", "key", "n_words")
    both = rows.join(by_row, (F.col("key") == F.col("j")) & F.col("id").eqNullSafe(F.col("i")), "left")
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no window of the benchmark."""
    dirty = lasting(hits(docs, benchmark, size, id_col, text_col).select("id", "key").distinct())
    return without(docs, dirty, F.xxhash64(text_col), id_col)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs; each hit word, with what stands between it and the next word, is cut out of the text."""
    found = hits(docs, benchmark, size, id_col, text_col)
    places = found.select("id", "key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p"))
    cut = places.groupBy(F.col("id").alias("__i"), F.col("key").alias("__k")).agg(F.collect_set("p").alias("__cut"))
    same = (F.xxhash64(docs[text_col]) == F.col("__k")) & docs[id_col].eqNullSafe(F.col("__i"))
    text = F.col(text_col)
    tokens = F.regexp_extract_all(text, F.lit(f"{WORD_ANY_CASE}[{WORD_ANY_CASE[2:-2]}]*"), F.lit(0))
    head = F.regexp_extract(text, f"^[{WORD_ANY_CASE[2:-2]}]*", 0)
    kept = F.filter(tokens, lambda t, i: ~F.array_contains(F.col("__cut"), i))
    clean = F.when(F.col("__cut").isNotNull(), F.concat(head, F.array_join(kept, ""))).otherwise(text)
    return docs.join(cut, same, "left").withColumn(text_col, clean).select(*docs.columns)


#: The same words before lower-casing: A-Z are letters too.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
