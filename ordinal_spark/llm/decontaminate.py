"""Operator 3: benchmark decontamination with SimHash windows. Expressions and
joins only; no Python runs on the rows.

Texts are words (A-Z lower-cased, split at white space), items and windows are
bags of five-word shingles (of all words, for items with fewer).

* A window has its item's number of words. It can only reach the similarity
  if enough of its shingles are the items' (6 of 7 for 0.75), so windows are
  laid at every start where a sliding count of shared shingles reaches that
  number. This prunes exactly, also for insertions and reorderings: all
  shingles of all documents are looked up, and no other window can reach it.
  Of equally similar windows, those go first in which a shared shingle lines up
  with an item's start (clipped to the document), then the earlier one.
* Windows and items get 64-bit SimHash fingerprints, which are cut into
  RADIUS + 1 blocks. Two fingerprints within RADIUS bits agree in a whole
  block, so joining on (item size, block number, block bits) finds every pair
  within the radius (multi-index Hamming search). At a similarity of 0.75,
  fingerprints differ in 11 of 64 bits with a deviation of 3; RADIUS lies four
  deviations above.
* Candidates are verified exactly: the sum of the smaller over the sum of the
  larger multiplicities of all shingles must be at least SIMILARITY.

The items' shingles are the only broadcast, below ``MAX_BROADCAST`` rows;
beyond, the planner shuffles. Only documents with a shared shingle are read
again. Null or blank texts and items match nothing; a null doc_id is kept;
repeated rows count once in the pairs. An item that a third of all documents
hold costs each of them about a seventh of its length in windows to both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import documents, text_rows, written

WORDS, SIMILARITY, RADIUS = 5, 0.75, 23
MAX_BROADCAST = 1_000_000
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)


def words(text: str) -> Column:
    low = F.btrim(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(SPACE))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, r"[\x20\x09-\x0D]+"))


def shingles(w: str, n: int) -> Column:
    """Hashes of the ``n``-word shingles of array ``w``, by position."""
    each = lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)])
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), each)).otherwise(F.array().cast("array<long>"))


def fingerprint(bag: str) -> Column:
    """SimHash of an array of shingle hashes: bit b is the majority of theirs."""
    votes = f"aggregate({bag}, 0, (s, x) -> s + CAST(shiftright(x, b) & 1L AS INT) * 2 - 1)"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(IF({votes} > 0, 1L, 0L), b))")


def blocks(radius: int) -> Column:
    """(number, bits) of the radius + 1 parts of column ``simhash``."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    part = lambda i, a, b: F.struct(F.lit(i).alias("number"), F.shiftrightunsigned("simhash", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
    return F.array(*[part(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))])


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two bags (arrays of hashes)."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    either = F.array_distinct(F.concat(a, b))
    least = F.aggregate(either, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return least / (F.size(a) + F.size(b) - least)


def starts(least: float) -> Column:
    """Every start whose window can reach ``least``, in order. ``p``: sorted
    positions of a document's shingles that items of ``n_words`` words hold;
    with r of them needed, p[i] and p[i + r - 1] lie in the windows that start
    from p[i + r - 1] - size + 1 to p[i]. A range begins after the one before."""
    return F.expr(f"""transform(array(struct(least(m, n_words) - gram + 1 AS size, greatest(0, m - n_words) AS top,
        greatest(1, CAST(ceil({least / (1 + least)!r}D * (least(m, n_words) + n_words - 2 * gram + 2) - 1e-6D) AS INT)) AS r)), k ->
        flatten(transform(filter(transform(sequence(0, greatest(0, size(p) - k.r)), i -> struct(
            greatest(0, get(p, i + k.r - 1) - k.size + 1, coalesce(get(p, i - 1) + 1, 0)) AS a, least(get(p, i), k.top) AS b)),
            x -> x.a <= x.b AND k.r <= size(p)), x -> sequence(x.a, x.b))))[0]""")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, h, item_id, start_word, similarity): the best window of each
    pair of a document and an item that match; ``h`` is the text's hash, which
    tells rows that repeat an id apart. ``benchmark``: (item_id, text)."""
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("w")).filter(F.size("w") > 0)
             .withColumn("n_words", F.size("w")).withColumn("gram", F.least("n_words", F.lit(n))))
    grams = [r["gram"] for r in items.select("gram").distinct().collect()]  # at most n numbers
    bag = F.coalesce(*[F.when(F.col("gram") == g, shingles("w", g)) for g in grams]) if grams else F.array().cast("array<long>")
    items = written(items.select("item_id", "n_words", "gram", bag.alias("bag")), "items")
    known = items.select("n_words", "gram", F.posexplode("bag").alias("offset", "shingle")).distinct()
    rows = text_rows(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    if known.count() <= MAX_BROADCAST:
        known = F.broadcast(known)

    def lookup(g: int) -> DataFrame:
        seen = (rows.select("doc_id", F.xxhash64("text").alias("h"), words("text").alias("w"))
                .select("doc_id", "h", F.size("w").alias("m"), F.posexplode(shingles("w", g)).alias("pos", "shingle")))
        lined = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("m") - F.col("n_words")))
        return (seen.join(known.filter(F.col("gram") == g).drop("gram"), "shingle")
                .select("doc_id", "h", "m", "n_words", F.lit(g).alias("gram"), "pos", lined.alias("lined")))

    hits = None
    for g in grams or [n]:
        hits = lookup(g) if hits is None else hits.union(lookup(g))
    hits = hits.groupBy("doc_id", "h", "m", "n_words", "gram").agg(F.sort_array(F.collect_set("pos")).alias("p"), F.collect_set("lined").alias("lined"))
    places = written(hits.select("doc_id", "h", "n_words", "gram", "lined", starts(least).alias("starts")).filter(F.size("starts") > 0), "windows")
    again = rows.withColumn("h", F.xxhash64("text")).join(places, ["doc_id", "h"]).select("doc_id", "h", "n_words", "gram", "lined", "starts", words("text").alias("w"))
    own = F.coalesce(*[F.when(F.col("gram") == g, shingles("w", g)) for g in grams or [n]])
    again = again.select("doc_id", "h", "n_words", "gram", "lined", "starts", own.alias("own"))
    cut = F.transform("starts", lambda s: F.struct(s.alias("start"), F.array_contains("lined", s).alias("line"),
                                                    F.slice("own", s + 1, F.col("n_words") - F.col("gram") + 1).alias("window")))
    again = again.select("doc_id", "h", "n_words", F.explode(cut).alias("x"))
    # tables end the expressions here, or they would be copied into each use
    cut = written(again.select("doc_id", "h", "x.start", "x.line", "n_words", "x.window"), "cuts")
    windows = written(cut.withColumn("simhash", fingerprint("window")), "fingerprints")
    marked = written(items.filter(F.size("bag") > 0).withColumn("simhash", fingerprint("bag")), "item-fingerprints")
    side = windows.withColumn("x", F.explode(blocks(radius))).select("*", "x.number", "x.bits").drop("x")
    other = (marked.withColumn("x", F.explode(blocks(radius)))
             .select("item_id", "n_words", "bag", F.col("simhash").alias("item_simhash"), "x.number", "x.bits"))
    near = side.join(other, ["n_words", "number", "bits"]).filter(F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_simhash"))) <= radius)
    # of the blocks in which a pair agrees, the first speaks for it
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    differ = F.col("simhash").bitwiseXOR(F.col("item_simhash"))
    first = F.coalesce(*[F.when(F.shiftrightunsigned(differ, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0, F.lit(i)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))])
    near = written(near.filter(F.col("number") == first).select("doc_id", "h", "start", "line", "item_id", "window", "bag"), "candidates")
    scored = near.withColumn("similarity", similarity("window", "bag")).filter(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", "line", (-F.col("start")).alias("s"))).alias("b")
    return (scored.groupBy("doc_id", "h", "item_id").agg(best)
            .select(F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"), "h", "item_id", (-F.col("b.s")).alias("start_word"), F.col("b.similarity").alias("similarity")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, that match no item."""
    bad = written(contaminated(docs, benchmark, **how).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_bad_id"), F.col("h").alias("_bad_h")).distinct(), "contaminated")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == bad["_bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_bad_h"])
    return docs.join(bad, same, "left_anti")


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start_word", F.round("similarity", 9).alias("similarity")).distinct()


QUERIES = {"op3_simhash_decontamination": op3_simhash_decontamination}
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_GRAMS = "list_transform(range(greatest(0, len({w}) - {g} + 1)), lambda i: array_to_string({w}[i + 1 : i + {g}], ' '))"
ORACLE = {"op3_simhash_decontamination": f"""
WITH item AS (SELECT *, least(5, len(w)) AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bag AS (SELECT item_id, len(w) AS n, g, {_GRAMS.format(w='w', g='g')} AS b FROM item),
shingle AS (SELECT DISTINCT n, g, unnest(range(len(b))) AS o, unnest(b) AS s FROM bag),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
seen AS (SELECT doc_id, w, g, len(w) AS m, unnest(range(len(x))) AS p, unnest(x) AS s
         FROM (SELECT doc_id, w, g, {_GRAMS.format(w='w', g='g')} AS x FROM doc, (SELECT DISTINCT g FROM bag))),
place AS (SELECT DISTINCT doc_id, w, seen.g, n, greatest(0, least(p - o, m - n)) AS start FROM seen JOIN shingle USING (g, s)),
win AS (SELECT doc_id, n, g, start, {_GRAMS.format(w='v', g='g')} AS a FROM (SELECT *, w[start + 1 : start + n] AS v FROM place)),
pair AS (SELECT doc_id, item_id, start, a, b FROM win JOIN bag USING (n, g)),
least_of AS (SELECT *, list_sum(list_transform(list_distinct(list_concat(a, b)),
    lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS c FROM pair),
scored AS (SELECT *, c::DOUBLE / (len(a) + len(b) - c) AS sim FROM least_of)
SELECT DISTINCT doc_id, item_id, start::INTEGER AS start_word, round(sim, 9) AS similarity FROM scored WHERE sim >= 0.75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) = 1"""}
