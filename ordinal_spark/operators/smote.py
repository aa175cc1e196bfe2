"""R5 SMOTE-NC oversampling, R6 full resample, R7 imbalance gate.

Metric (Chawla et al. 2002, SMOTE-NC): one continuous feature ``s`` and F
categorical features ``g``; d^2(i, j) = (s_i - s_j)^2 + Med^2 * H(g_i, g_j),
where H counts differing categories and Med is the standard deviation of the
continuous feature inside the class (the median over continuous features;
there is one). A class whose continuous feature has no spread uses Med = 1.

Exact k nearest neighbours without emitting all pairs of a class:

* Rows with identical features collapse into one *point* with a multiplicity;
  neighbours are found between points (a row's own duplicates are its
  distance-0 neighbours).
* Categories become codes (closed lists, so a dictionary is small) packed into
  longs: the *signature*. Points are searched in Hamming rings: ring h holds
  the points that differ in exactly h features. For each choice of h features
  the signature without them is a key, and the points of one key are sorted by
  score; a point needs the k + 1 rows before and after it only, for what lies
  beyond has k rows of the same key before it that are no farther. So no pairs
  are made: a point has as many keys in ring h as there are choices of h
  features, whatever the table's size.
* A ring drops candidates beyond the k-th distance so far. A point is finished
  when its k-th distance is below (h+1) Med^2, since all later rings start
  there; only open points go on, and in a dense table few pass ring 2.
* Joins on points are sort-merge joins: keys multiply a point by the choices of
  features, which size estimates leave out, and what they take for small would
  be broadcast through the driver's memory.
* Equal distances go by score and then by signature, which is a point's id.

Synthetic rows (imbalanced-learn convention): base row uniform among the
class rows, neighbour uniform among its k neighbour rows, continuous value
x + u (x_nn - x), each category the most frequent among the k neighbours
(ties: smallest value). Randomness is md5-derived from (seed, class, sample
number), so results are deterministic and identical across recomputation.
"""

from __future__ import annotations

from itertools import combinations
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col
from ..session import cut_lineage, pin_columns
from .ranking import hash_order, rank_within


def _uniform(*parts) -> F.Column:
    """Deterministic U[0, 1) from md5 of the joined parts (52 bits)."""
    h = F.md5(F.concat_ws("|", *[p if isinstance(p, F.Column) else F.lit(str(p)) for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


WORD = 62  # bits of a packed long


def most_frequent(values: str) -> F.Column:
    """The value that an array holds most often; of several the smallest."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x.eqNullSafe(v)))).alias("n"), v.alias("v")))
    return F.array_min(counted)["v"]


class Signatures:
    """Dictionary codes of the category columns (0: null), packed into longs of
    equal fields, the first column in the highest field: comparing the longs
    compares the values column by column."""

    def __init__(self, rows: DataFrame, cats: Sequence[str]) -> None:
        self.cats = list(cats)
        found = rows.agg(*[F.collect_set(col(c)).alias(c) for c in cats]).first() if cats else {}  # closed lists
        self.levels = {c: sorted(found[c]) for c in cats}
        self.width = max([1, *(len(v).bit_length() for v in self.levels.values())])
        self.each = WORD // self.width
        self.words = [f"_w{i}" for i in range(max(1, -(-len(self.cats) // self.each)))]

    def columns(self) -> list:
        out = []
        for i, name in enumerate(self.words):
            packed = F.lit(0).cast("long")
            for c in self.cats[i * self.each:(i + 1) * self.each]:
                code = F.create_map(*[F.lit(x) for n, v in enumerate(self.levels[c], 1) for x in (v, n)])[col(c)] if self.levels[c] else F.lit(None)
                packed = packed * (1 << self.width) + F.coalesce(code, F.lit(0)).cast("long")
            out.append(packed.alias(name))
        return out

    def mask(self, features: Sequence[int]) -> list[int]:
        """Bits of some features in each word."""
        out = [0] * len(self.words)
        for f in features:
            word, place = divmod(f, self.each)
            last = min(self.each, len(self.cats) - word * self.each) - 1
            out[word] |= ((1 << self.width) - 1) << (self.width * (last - place))
        return out

    def texts(self, feature: int, rows: str) -> F.Column:
        """The values of a feature, as text, of the signatures in the array ``rows``."""
        word, place = divmod(feature, self.each)
        shift = self.width * (min(self.each, len(self.cats) - word * self.each) - 1 - place)
        values = self.levels[self.cats[feature]]
        named = F.array(*[F.lit(v).cast("string") for v in values]) if values else F.array().cast("array<string>")
        return F.transform(rows, lambda x: F.get(named, F.shiftright(x[self.words[word]], shift).bitwiseAND(F.lit((1 << self.width) - 1)).cast("int") - 1))

    def differing(self, a: str, b) -> F.Column:
        """How many features differ between the words ``a.*`` and ``b``'s."""
        ones = sum(1 << (self.width * i) for i in range(self.each))
        out = F.lit(0)
        for w in self.words:
            x = F.col(f"{a}{w}").bitwiseXOR(b[w])
            folded = x
            for shift in range(1, self.width):
                folded = folded.bitwiseOR(F.shiftright(x, shift))
            out = out + F.bit_count(folded.bitwiseAND(F.lit(ones)))
        return out


def _keys(points: DataFrame, sig: Signatures, ring: int) -> DataFrame:
    """``points`` once for each choice of ``ring`` features, with its number
    ``_choice`` and the words without them (``_k0``, ...)."""
    rows = []
    for i, features in enumerate(combinations(range(len(sig.cats)), ring)):
        rows.append(F.struct(F.lit(i).alias("_choice"), *[
            F.col(w).bitwiseAND(F.lit(~m)).alias(f"_k{j}") for j, (w, m) in enumerate(zip(sig.words, sig.mask(features)))]))
    return points.select("*", F.inline(F.array(*rows)))


def _ring(points: DataFrame, open_: DataFrame, sig: Signatures, ring: int, k: int) -> DataFrame:
    """(_y, _s, words, _found): for each open point its ``k`` best candidates at
    Hamming distance ``ring`` that are within ``_ub``."""
    key = ["_y", "_choice", *[f"_k{i}" for i in range(len(sig.words))]]
    mine = _keys(open_.select("_y", "_s", *sig.words, "_med", "_ub"), sig, ring)
    # rows of a key with one score: the k + 1 first by signature can matter
    entries = _keys(points.select("_y", "_s", *sig.words, "_m"), sig, ring)
    if ring:
        entries = entries.join(mine.select(*key).distinct().hint("merge"), key, "left_semi")
    same = Window.partitionBy(*key, "_s").orderBy(*sig.words)
    entries = entries.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1)
    runs = entries.groupBy(*key, "_s").agg(F.collect_list(F.struct("_s", *sig.words, "_m")).alias("_run"))
    near = Window.partitionBy(*key).orderBy("_s").rowsBetween(-(k + 1), k + 1)
    runs = runs.select(*key, "_s", F.flatten(F.collect_list("_run").over(near)).alias("_around"))
    d2 = lambda x: (F.col("_s") - x["_s"]) * (F.col("_s") - x["_s"]) + F.col("_med") * F.col("_med") * ring
    cand = F.transform("_around", lambda x: F.struct(
        d2(x).alias("_d2"), x["_s"].alias("_s"), *[x[w].alias(w) for w in sig.words],
        (x["_m"] - (F.lit(ring == 0) & (x["_s"] == F.col("_s"))).cast("long")).alias("_m"),
        sig.differing("", x).alias("_h")))
    cand = F.filter(cand, lambda x: (x["_h"] == ring) & (x["_m"] > 0) & (F.col("_ub").isNull() | (x["_d2"] <= F.col("_ub"))))
    best = F.slice(F.array_sort(cand), 1, k)
    found = mine.join(runs.hint("merge"), [*key, "_s"]).select("_y", "_s", *sig.words, best.alias("_found")).where(F.size("_found") > 0)
    return found.groupBy("_y", "_s", *sig.words).agg(F.flatten(F.collect_list("_found")).alias("_found"))


def _reach(near: str, k: int) -> F.Column:
    """The distance at which ``k`` rows are covered; null if fewer are known."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d"))
    step = lambda a, x: F.struct((a["n"] + x["_m"]).alias("n"), F.coalesce(a["d"], F.when(a["n"] + x["_m"] >= k, x["_d2"])).alias("d"))
    return F.aggregate(near, start, step, lambda a: a["d"])


def points_of(rows: DataFrame, label: str, cont: str, sig: Signatures) -> DataFrame:
    """(_y, _s, words, cats, _m): the distinct points and their rows."""
    return (rows.groupBy(col(label).alias("_y"), col(cont).cast("double").alias("_s"), *[col(c).alias(c) for c in sig.cats])
            .agg(F.count(F.lit(1)).alias("_m")).select("*", *sig.columns()))


def point_id(sig: Signatures, score, words: str = "") -> F.Column:
    """The score and signature as one column, which sorts like them."""
    return F.struct(score.cast("double").alias("_s"), *[F.col(f"{words}{w}").alias(w) for w in sig.words])


def nearest_lists(rows: DataFrame, label: str, cont: str, cats: Sequence[str], k: int = 5,
                  classes: Sequence | None = None, sig: Signatures | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact k-NN of every point of the given classes.

    Returns (points, lists): points(_y, _s, cats..., _m, _pid, _med) and
    lists(_y, _s, words, _near) - the neighbour points of each point in
    (distance, point id) order with their rows ``_m``, ``k`` rows at least where
    the class has them.
    """
    cats = list(cats)
    r = rows if classes is None else rows.where(col(label).isin(*classes))
    sig = sig or Signatures(r, cats)
    med = r.groupBy(col(label).alias("_y")).agg(F.stddev_pop(col(cont)).alias("_sd"))
    # to 13 digits: the last ones go by the order of summing, and would decide between equal distances
    spread = F.format_string("%.12e", "_sd").cast("double")
    med = med.select("_y", F.when(F.col("_sd") > 0, spread).otherwise(F.lit(1.0)).alias("_med"))
    pts = points_of(r, label, cont, sig).join(F.broadcast(med), "_y")  # class table: K rows
    pts = pin_columns(pts.withColumn("_pid", point_id(sig, F.col("_s"))), "points")

    item = "struct<_d2:double,_s:double," + "".join(f"{w}:bigint," for w in sig.words) + "_m:bigint,_h:int>"
    open_ = pts.select("_y", "_s", *sig.words, "_med", F.lit(None).cast("double").alias("_ub"), F.expr(f"cast(array() as array<{item}>)").alias("_near"))
    done = None
    for ring in range(len(cats) + 1):
        found = _ring(pts, open_, sig, ring, k)
        # ``k`` entries hold k rows at least
        merged = F.slice(F.array_sort(F.concat("_near", F.coalesce("_found", F.expr(f"cast(array() as array<{item}>)")))), 1, k)
        state = (open_.join(found.hint("merge"), ["_y", "_s", *sig.words], "left").select("_y", "_s", *sig.words, "_med", merged.alias("_near"))
                 .withColumn("_ub", _reach("_near", k)))
        closed = F.coalesce(F.col("_ub") < F.col("_med") * F.col("_med") * (ring + 1), F.lit(False)) | F.lit(ring == len(cats))
        state = pin_columns(state.withColumn("_closed", closed), "ring")
        part = state.where("_closed").select("_y", "_s", *sig.words, "_near")
        done = part if done is None else done.unionByName(part)
        open_ = state.where(~F.col("_closed")).drop("_closed")
        if open_.isEmpty():
            break
    return pts, done


def nearest_points(rows: DataFrame, label: str, cont: str, cats: Sequence[str], k: int = 5,
                   classes: Sequence | None = None, sig: Signatures | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, slots) of ``nearest_lists``: slots(_y, _pid, slot 0..k-1, _nb) -
    the k neighbour rows of each point in order; fewer where the class has
    fewer rows."""
    sig = sig or Signatures(rows if classes is None else rows.where(col(label).isin(*classes)), list(cats))
    pts, done = nearest_lists(rows, label, cont, cats, k, classes, sig)
    # the rows of each neighbour take as many slots
    nbr = done.select("_y", point_id(sig, F.col("_s")).alias("_pid"), F.posexplode("_near").alias("_i", "_n"), "_near")
    before = F.aggregate(F.slice("_near", F.lit(1), F.col("_i")), F.lit(0).cast("long"), lambda a, x: a + x["_m"])
    nbr = nbr.select("_y", "_pid", before.alias("_cs"), (before + F.col("_n._m")).alias("_ce"),
                     point_id(sig, F.col("_n._s"), "_n.").alias("_nb")).where(F.col("_cs") < k)
    slots = (nbr.withColumn("slot", F.explode(F.sequence(F.col("_cs").cast("int"), F.least(F.col("_ce"), F.lit(k)).cast("int") - 1)))
             .select("_y", "_pid", "slot", "_nb"))
    return pts, cut_lineage(slots)


def smote_nc(rows: DataFrame, label: str, key: str, cont: str, cats: Sequence[str],
             n_new: Mapping, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows for every class in ``n_new`` (class -> count).

    Output columns: key ('syn|<class>|<n>'), label, cont, cats.
    """
    cats = list(cats)
    need = {c: int(n) for c, n in n_new.items() if int(n) > 0}
    spark = rows.sparkSession
    if not need:
        return rows.select(col(key).cast("string").alias(key), col(label), col(cont), *cats).limit(0)
    classes = list(need)
    base = rows.where(col(label).isin(*classes))
    counts = {r[0]: r[1] for r in base.groupBy(col(label)).count().collect()}  # K rows
    small = {c: counts.get(c, 0) for c in classes if counts.get(c, 0) <= k}
    if small:
        raise ValueError(f"classes with too few rows for {k} neighbours: {small}")
    sig = Signatures(base, cats)
    _, near = nearest_lists(base, label, cont, cats, k, classes, sig)

    # base rows numbered inside their class (no single task per class)
    ranked = rank_within(base.select(col(key), col(label), col(cont), *cats), [label],
                         [hash_order(seed, key), key], out="_rank")
    ranked = ranked.select("*", *sig.columns()).withColumn("_pid", point_id(sig, col(cont))).drop(*sig.words)

    # sample numbers: one distributed range; class and in-class number from
    # cumulative offsets (K classes, a literal CASE chain)
    ltype = base.schema[label].dataType
    g = F.col("id")
    cls, first, size = None, None, None
    tot = 0
    for c in classes:
        lo, tot = tot, tot + need[c]
        cond = g < F.lit(tot)
        cls = F.when(cond, F.lit(c)) if cls is None else cls.when(cond, F.lit(c))
        first = F.when(cond, F.lit(lo)) if first is None else first.when(cond, F.lit(lo))
        size = F.when(cond, F.lit(counts[c])) if size is None else size.when(cond, F.lit(counts[c]))
    samp = spark.range(tot).select(cls.cast(ltype).alias("_y"), (g - first).alias("_t"),
                                   size.alias("_m"))
    samp = samp.select(
        "_y", "_t",
        (F.floor(_uniform(seed, F.col("_y"), F.col("_t"), "base") * F.col("_m")) + 1)
        .cast("long").alias("_rank"),
        F.floor(_uniform(seed, F.col("_y"), F.col("_t"), "nb") * k).cast("int").alias("slot"),
        _uniform(seed, F.col("_y"), F.col("_t"), "step").alias("_u"))
    with_base = samp.join(ranked.select(col(label).alias("_y"), "_rank", col(cont), "_pid").hint("merge"), ["_y", "_rank"])
    # a point's k neighbour rows: their scores, and the mode of each category among them
    rows_of = F.slice(F.flatten(F.transform("_near", lambda x: F.array_repeat(x, F.least(x["_m"], F.lit(k)).cast("int")))), 1, k)
    types = {c: rows.schema[c].dataType for c in cats}
    near = near.select("_y", point_id(sig, F.col("_s")).alias("_pid"), rows_of.alias("_rows"))
    near = near.select("_y", "_pid", F.transform("_rows", lambda x: x["_s"]).alias("_scores"), *[sig.texts(i, "_rows").alias(f"_v{i}") for i in range(len(cats))])
    near = near.select("_y", "_pid", "_scores", *[most_frequent(f"_v{i}").cast(types[c]).alias(c) for i, c in enumerate(cats)])
    gen = with_base.join(near.hint("merge"), ["_y", "_pid"])
    neighbour = F.get("_scores", F.col("slot"))
    out = gen.select("_y", "_t", (F.col(cont) + F.col("_u") * (neighbour - F.col(cont))).alias(cont), *[col(c) for c in cats])
    return out.select(F.concat_ws("|", F.lit("syn"), F.col("_y").cast("string"),
                                  F.col("_t").cast("string")).alias(key),
                      F.col("_y").alias(label), col(cont).cast(rows.schema[cont].dataType).alias(cont),
                      *cats)


def resample_training(df: DataFrame, label: str, key: str, cont: str, specs: Sequence,
                      k: int = 5, seed: int = 42, ratio: float = 0.75,
                      oversample: Mapping[int, float] | None = None) -> DataFrame:
    """Undersample the majority class (R2/R4), decode the dummies (P4),
    SMOTE-NC the planned minority classes (R3/R5), re-encode (P3) and return
    the rows in the input's column order (dummies as doubles)."""
    from .encode import dummy_decode_all, dummy_encode
    from .resample import sampling_plan, undersample
    plan = sampling_plan(df, label, ratio, oversample)
    held = plan.collect()  # K rows
    targets = {r["class"]: (int(r["under_target"]), int(r["over_target"])) for r in held}
    if held:
        plan = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[
            F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in plan.schema]) for r in held])))
    # read by each of the passes below
    under = pin_columns(undersample(df, label, key, plan, seed), "undersampled")
    decoded = dummy_decode_all(under, specs)
    cats = [c for c in decoded.columns if c not in (key, label, cont)]
    n_new = {c: o - u for c, (u, o) in targets.items() if o > u}
    synth = smote_nc(decoded.select(key, label, cont, *cats), label, key, cont, cats, n_new, k, seed)
    enc = dummy_encode(synth, specs)
    cols = [c for c in df.columns]
    enc = enc.select(*[F.col(f"`{c}`").cast(df.schema[c].dataType).alias(c)
                       for c in cols if c in enc.columns])
    return under.unionByName(enc, allowMissingColumns=True)


def rebalance(df: DataFrame, label: str, key: str, cont: str, specs: Sequence,
              threshold: float = 3.0, **kw) -> DataFrame:
    """Resample only when max/min class count exceeds ``threshold``.
    Failures raise (the original logged them and silently kept the data)."""
    counts = [r[1] for r in df.groupBy(col(label)).count().collect()]  # K rows
    if not counts or max(counts) / min(counts) <= threshold:
        return df
    return resample_training(df, label, key, cont, specs, **kw)
