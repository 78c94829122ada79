"""Which project a path belongs to: roots, codes, aliases, similar names. All are equi-joins on parts of the path."""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DoubleType

from lodefall.operators import facts
from lodefall.session import checkpointed, ship

#: Words that don't make an alias.
COMMON = ("the", "at", "of", "and", "&", "a", "an", "in", "on", "by", "for", "project", "building", "tower", "centre", "center", "complex")
GRAM = 3


def parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")


def beginnings(paths: DataFrame, key: str, path: str, roots: DataFrame, root: str) -> DataFrame:
    """key and _cut: the path cut at each of the roots' lengths where it has the last character of a root of that length."""
    ends = roots.agg(F.collect_set(F.struct(F.length(root).alias("n"), F.right(root, F.lit(1)).alias("last"))).alias("_ends"))  # a small row: lengths and characters
    like = lambda x: (x["n"] <= F.length(path)) & ((x["n"] == 0) | (F.substring(path, x["n"], F.lit(1)) == x["last"]))
    return paths.select(key, path).crossJoin(F.broadcast(ends)).select(key, F.explode(F.transform(F.filter("_ends", like), lambda x: F.substring(path, F.lit(1), x["n"]))).alias("_cut"))


def by_prefix(paths: DataFrame, key: str, path: str, roots: DataFrame, root: str, order: str, value: str) -> DataFrame:
    """key and value of the first root (by `order`) that begins the path. The path is cut where a root can end, which no
    longer path than the longest root can exceed, and joined on equality."""
    known = roots.where(F.col(root).isNotNull())
    cut = beginnings(paths, key, path, known, root)
    # rows a path are more than the paths' size tells: never broadcast
    return cut.hint("merge").join(known.select(root, order, value), F.col("_cut") == F.col(root)).groupBy(key).agg(F.min_by(value, order).alias(value))


def by_code(paths: DataFrame, key: str, path: str, cards: DataFrame, code: str) -> DataFrame:
    """key and code of the first part of the path whose first number of 3 or 4 digits is a known code."""
    number = F.regexp_extract("_part", r"\b([0-9]{3,4})\b", 1)
    cut = paths.select(key, F.posexplode(parts(F.col(path))).alias("_pos", "_part")).select(key, "_pos", number.alias("_code")).where("_code <> ''")
    known = cards.select(F.col(code).cast("string").alias("_code")).where("_code IS NOT NULL").distinct()
    return cut.hint("merge").join(known, "_code").groupBy(key).agg(F.min_by("_code", "_pos").alias(code))


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct runs of n characters; none in shorter texts."""
    size = F.length(text) - (n - 1)
    return F.when(size > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


#: Aliases up to which one automaton of them all goes to the workers (a few MB); beyond it paths and aliases are joined.
ALIASES = 20_000


def by_alias(paths: DataFrame, key: str, path: str, aliases: DataFrame, alias: str, order: str, value: str) -> DataFrame:
    """key and value of the longest alias (3 characters at least; then by `order`) within the path, case ignored."""
    a = aliases.select(F.lower(alias).alias("_alias"), F.col(order).alias("_order"), F.col(value).alias(value)).where(F.length("_alias") >= GRAM)
    a = a.groupBy("_alias").agg(F.min(F.struct("_order", value)).alias("_x")).select("_alias", F.col("_x._order").alias("_order"), F.col(f"_x.{value}").alias(value))
    p = paths.select(key, F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).alias("_path"))
    if a.limit(ALIASES + 1).count() <= ALIASES:
        return found_aliases(p, key, a.collect(), value)  # bounded
    return joined_aliases(p, key, a, value)


def found_aliases(p: DataFrame, key: str, aliases: list, value: str) -> DataFrame:
    """The longest alias of each path by one pass of an automaton over it."""
    import ahocorasick

    shared = p.sparkSession.sparkContext.broadcast([(x["_alias"], x["_order"], x[value]) for x in aliases])
    kind = T.StructType([p.schema[key], T.StructField(value, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for text, order, found in shared.value:
            automaton.add_word(text, (len(text), -order, found))
        if not len(automaton):
            return
        automaton.make_automaton()
        for batch in batches:
            best = [max((x for _, x in automaton.iter(text or "")), default=None) for text in batch.column("_path").to_pylist()]
            held = pa.array([x is not None for x in best])
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(held), pa.array([x[2] for x in best if x], pa.string())], [key, value])

    return p.mapInArrow(run, kind)


#: The lengths of runs by which aliases are met: an alias has runs of the greatest of them that it is as long as.
RUNS = (GRAM, 6, 12, 24)


def joined_aliases(p: DataFrame, key: str, a: DataFrame, value: str) -> DataFrame:
    """The same by a join on the alias's run of characters that fewest aliases have, then verified; so aliases that
    begin alike don't all meet each path. The longer an alias, the longer its runs, so that even of many aliases few share one. Paths and
    runs meet as hashes, a path once however often it occurs: equal hashes of what differs are sorted out when verified."""
    size = F.coalesce(*(F.when(F.length("_alias") >= n, n) for n in reversed(RUNS)))
    of_size = lambda text: F.coalesce(*(F.when(F.length("_alias") >= n, grams(F.col(text), n)) for n in reversed(RUNS)))
    runs = a.select("_alias", size.alias("_size"), F.explode(of_size("_alias")).alias("_gram")).select("_alias", "_size", F.xxhash64("_gram").alias("_gram"))
    rare = runs.hint("merge").join(runs.groupBy("_gram").agg(F.count("*").alias("_n")), "_gram").groupBy("_alias").agg(F.min(F.struct("_n", "_gram", "_size")).alias("_rare"))
    known = rare.select("_alias", "_rare._gram")
    sizes = [r["_size"] for r in rare.select("_rare._size").distinct().collect()] or [GRAM]  # some of RUNS
    texts = p.select("_path").where("_path IS NOT NULL").distinct().withColumn("_at", F.xxhash64("_path"))
    cut = texts.select("_at", F.explode(F.flatten(F.array(*(F.transform(grams(F.col("_path"), n), lambda g: F.xxhash64(g)) for n in sorted(sizes))))).alias("_gram"))
    met = cut.hint("merge").join(known, "_gram").select("_at", "_alias")
    hits = met.hint("merge").join(texts, "_at").where(F.contains("_path", F.col("_alias"))).select("_path", "_alias")
    best = hits.hint("merge").join(a, "_alias").groupBy("_path").agg(F.max_by(value, F.struct(F.length("_alias"), -F.col("_order"), value)).alias(value))
    return p.hint("merge").join(best, "_path").select(key, value)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Ratcliff-Obershelp ratio."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: The runs of characters by which similar strings meet, and what is put around a string, so that its ends count too.
PAIR, OPEN, CLOSE = 2, "\x02", "\x03"
#: Words of 64 bits in the sketch of a string's runs.
WORDS = 4
#: Lengths are told apart by bands, each this much longer than the one before; up to the band of TOP (44 to 55 characters) by themselves.
STEP, TOP = 1.25, 17
#: Two bands meet by what is left of their strings where that is at most LEFT rows a string and length, and as rows at most
#: one in SHARE of the pairs, which is about what runs of characters cost.
LEFT, SHARE = 500, 128
#: Rows of what is left that a task makes.
EACH = 500_000


def ordered_pairs(strings: DataFrame, weights: DataFrame) -> DataFrame:
    """_s, _n (length), _k (distinct runs), _gs, its distinct runs of two characters, those of the least weight first, and
    _b0, _b1 ..., a bit for each of them by its hash: a row a string."""
    cut = strings.select("_s", F.explode(grams(F.concat(F.lit(OPEN), "_s", F.lit(CLOSE)), PAIR)).alias("_gram"))
    at = F.pmod(F.xxhash64("_gram"), F.lit(64 * WORDS))
    bits = [F.bit_or(F.when(at >= 64 * w, F.when(at < 64 * (w + 1), F.expr("shiftleft(1L, cast(pmod(xxhash64(_gram), 64) as int))")))) for w in range(WORDS)]
    whole = cut.hint("merge").join(weights, "_gram").groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("_weight", "_gram"))).alias("_gs"), *(F.coalesce(b, F.lit(0)).cast("long").alias(f"_b{w}") for w, b in enumerate(bits)))
    return whole.select("_s", F.length("_s").alias("_n"), F.size("_gs").alias("_k"), F.col("_gs._gram").alias("_gs"), *(f"_b{w}" for w in range(WORDS)))


def band(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(STEP)).cast("int")


def matching(both: Column, threshold: float) -> Column:
    """How many characters of two strings of `both` characters together match at least, when their ratio (2 M / both) is over the threshold."""
    return F.floor(both * (threshold / 2) + 1e-9).cast("int") + 1


def shared_runs(both: Column, threshold: float) -> Column:
    """How many runs of two characters (each as often as it occurs, the ends' included) two strings of `both` characters
    together have in common at least, when their ratio is over the threshold. M characters that match, and the two ends, lie
    in at most one more stretch than there are characters that don't, which are both - 2 M."""
    return 3 * matching(both, threshold) - both + 1


class Meeting:
    """How the strings of two sides meet, by their bands: `lefts` has for each side and length of its strings how many characters are
    to be left of them, `work` the rows of that, and `runs` for each side and band the bands that it meets by runs."""

    def __init__(self, shapes: list, threshold: float):
        self.lefts: tuple[dict[int, set[int]], ...] = ({}, {})
        self.runs: tuple[dict[int, list[int]], ...] = ({}, {})
        self.work = 0
        sides: tuple[dict[int, list], ...] = ({}, {})
        for r in shapes:
            sides[r["_side"]].setdefault(r["_band"], []).append(r)
        most = (2 - threshold) / threshold
        apart = lambda x, y: STEP**y - 2 > (STEP ** (x + 1) + 1) * most  # noqa: E731 - all of y are too long for x
        for x, y in ((x, y) for x in sides[0] for y in sides[1] if not (apart(x, y) or apart(y, x))):
            pairs = sum(r["count"] for r in sides[0][x]) * sum(r["count"] for r in sides[1][y])
            if max(x, y) <= TOP and self._by_left(sides[0][x], sides[1][y], pairs, threshold):
                continue
            self.runs[0].setdefault(x, []).append(y)
            self.runs[1].setdefault(y, []).append(x)

    def _by_left(self, xs: list, ys: list, pairs: int, threshold: float) -> bool:
        wanted: tuple[dict[int, set[int]], ...] = ({}, {})
        for n, m in {(r["_n"], q["_n"]) for r in xs for q in ys}:
            same = math.floor((n + m) * (threshold / 2) + 1e-9) + 1  # as `matching`
            if same <= min(n, m):
                wanted[0].setdefault(n, set()).add(same)
                wanted[1].setdefault(m, set()).add(same)
        sizes = [(r["count"], math.comb(r["_k"], same)) for side, rows in zip(wanted, (xs, ys), strict=True) for r in rows for same in side.get(r["_n"], ())]
        cost = sum(n * size for n, size in sizes)
        if max((size for _, size in sizes), default=0) > LEFT or cost * SHARE > pairs:
            return False
        self.work += cost
        for side, more in zip(self.lefts, wanted, strict=True):
            for n, sames in more.items():
                side.setdefault(n, set()).update(sames)
        return True


def shaped(xs: DataFrame, ys: DataFrame) -> tuple[DataFrame, ...]:
    """Both sides' strings _s with their length _n, band _band, and _t, the string without the characters that the other side has nowhere."""
    letters = lambda rows, side: rows.select(F.explode(grams(F.col("_s"), 1)).alias("_c"), F.lit(side).alias("_side")).distinct()
    alone = letters(xs, 0).union(letters(ys, 1)).groupBy("_c").agg(F.min("_side").alias("_side"), F.count("*").alias("n")).where("n = 1").collect()  # letters: bounded
    foreign = ["".join(r["_c"] for r in alone if r["_side"] == side) for side in (0, 1)]
    return tuple(rows.select("_s", F.length("_s").alias("_n"), band(F.length("_s")).alias("_band"), F.translate("_s", gone, "").alias("_t")) for rows, gone in zip((xs, ys), foreign, strict=True))


def shapes(xs: DataFrame, ys: DataFrame) -> list:
    """How many strings there are of each length and rest, in bands over TOP of the band alone: a bounded number of rows."""
    near = F.col("_band") <= TOP
    rows = reduce(DataFrame.union, (df.select(F.lit(side).alias("_side"), "_band", F.when(near, F.col("_n")).alias("_n"), F.when(near, F.length("_t")).alias("_k")) for side, df in enumerate((xs, ys))))
    return rows.groupBy("_side", "_band", "_n", "_k").count().collect()


def by_key(known: dict, key: str, item: Callable) -> Column:
    """The array of what a small dictionary has for the key, or null."""
    return F.create_map(*(c for k, vs in known.items() for c in (F.lit(k), F.array(*(item(v) for v in sorted(vs))))))[F.col(key)]


def subsequences(text: Column, size: Column) -> Column:
    """The distinct strings of `size` characters that are left of a text of as many or more (none above the band of TOP) by leaving out the others."""
    places = F.sequence(F.lit(1), F.lit(math.ceil(STEP ** (TOP + 1))))
    gone = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
    # one more left out, never before the one left out last
    later = lambda x: F.slice(places, x["at"], F.greatest(F.length(x["s"]) - x["at"] + 1, F.lit(0)))
    less = lambda x: F.transform(later(x), lambda i: F.struct(gone(x["s"], i).alias("s"), i.alias("at")))
    whole = F.array(F.struct(text.alias("s"), F.lit(1).alias("at")))
    return F.array_distinct(F.aggregate(F.slice(places, F.lit(1), F.length(text) - size), whole, lambda so_far, _: F.flatten(F.transform(so_far, less)))["s"])


def met_by_left(xs: DataFrame, ys: DataFrame, meeting: Meeting, threshold: float) -> DataFrame:
    """_sx and _sy, some of them often, of strings that have as many characters in common, in one order, as a ratio over the threshold
    takes: leaving out others leaves the same string of both. Hashes of these meet, so hardly any other pairs do."""

    def left(rows: DataFrame, side: int) -> DataFrame:
        sizes = F.filter(by_key(meeting.lefts[side], "_n", F.lit), lambda m: m <= F.length("_t"))
        each = rows.where(F.col("_n").isin(list(meeting.lefts[side]))).repartition(meeting.work // EACH + 1, "_s").select("_s", "_t", F.explode(sizes).alias("_m"))
        return each.select(F.col("_s").alias("_s" + "xy"[side]), F.col("_m").alias("_m" + "xy"[side]), F.explode(F.transform(subsequences(F.col("_t"), F.col("_m")), lambda s: F.xxhash64(s))).alias("_left"))

    met = left(xs, 0).hint("merge").join(left(ys, 1).drop("_my"), "_left")
    return met.where(F.col("_mx") == matching(F.length("_sx") + F.length("_sy"), threshold)).select("_sx", "_sy")


def met_by_runs(xs: DataFrame, ys: DataFrame, meeting: Meeting, threshold: float) -> DataFrame:
    """_sx and _sy, some of them often, of strings that share the runs of two characters that a ratio over the threshold takes.

    A string of n characters has n + 1 runs of two, its ends included; similar strings have `shared_runs` of them in
    common. With all runs in one order, the first that two such strings share is, in each, among as many of the first
    runs as may be missing, and one more. So strings meet in an equi-join on these prefixes, a few rows for each band of lengths. The order is by how
    many pairs a run would make; runs that one side alone has come first and meet nothing. Where they meet, the
    runs behind must suffice for what has to be shared, and no more bits of the one's sketch than runs may be missing can lack in
    the other's; then the edit distance is tested."""
    most, slack, sketch = (2 - threshold) / threshold, 1e-9, [f"_b{w}" for w in range(WORDS)]

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.explode(grams(F.concat(F.lit(OPEN), "_s", F.lit(CLOSE)), PAIR)).alias("_gram")).groupBy("_gram").agg(F.count("*").alias(name))

    def prefixes(rows: DataFrame, side: int) -> DataFrame:
        other = by_key(meeting.runs[side], "_band", lambda v: F.struct(F.lit(v).alias("band"), F.lit(math.floor(STEP**v) - 1).alias("least")))
        rows = rows.withColumn("_band", band(F.col("_n"))).withColumn("_other", F.explode(other))
        shortest = F.greatest(F.ceil(F.col("_n") / most - slack).cast("int"), F.col("_other.least"))
        # what must be shared rises by 0.2 a character at least and is less than 3 above that line: none later is lower
        least = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: shared_runs(F.col("_n") + shortest + i, threshold)))
        runs = F.slice("_gs", F.lit(1), F.greatest(F.col("_n") + 2 - least, F.lit(1)))
        bands = (F.col("_band"), F.col("_other.band")) if side == 0 else (F.col("_other.band"), F.col("_band"))
        return rows.select("_s", "_n", "_k", *sketch, (bands[0] * 256 + bands[1]).alias("_bands"), F.posexplode(runs).alias("_at", "_gram"))

    xs, ys = (rows.where(F.col("_band").isin(list(known))).select("_s") for rows, known in zip((xs, ys), meeting.runs, strict=True))
    weights = counts(xs, "_x").join(counts(ys, "_y"), "_gram", "full").select("_gram", (F.coalesce("_x", F.lit(0)) * F.coalesce("_y", F.lit(0))).alias("_weight"))
    named = lambda rows, side: prefixes(ordered_pairs(rows, weights), side).select("_gram", "_bands", *(F.col(c).alias(c + "xy"[side]) for c in ("_s", "_n", "_k", "_at", *sketch)))
    both = F.col("_nx") + F.col("_ny")
    shared = shared_runs(both, threshold)
    # runs that one has more than once count once among the distinct
    needed = shared - F.least(F.col("_nx") + 1 - F.col("_kx"), F.col("_ny") + 1 - F.col("_ky"))
    lacking = lambda x, y: reduce(Column.__add__, (F.bit_count(F.col(b + x).bitwiseAND(F.bitwise_not(b + y))) for b in sketch))
    close = (F.greatest("_nx", "_ny") <= F.least("_nx", "_ny") * most + slack) & (F.least(F.col("_kx") - F.col("_atx"), F.col("_ky") - F.col("_aty")) >= needed)
    close = close & (lacking("x", "y") <= F.col("_nx") + 1 - shared) & (lacking("y", "x") <= F.col("_ny") + 1 - shared)
    # one condition, the dear test last
    near = F.expr(f"levenshtein(_sx, _sy, cast(floor({1 - threshold}D * (_nx + _ny) + {slack}D) as int)) >= 0")
    return named(xs, 0).hint("merge").join(named(ys, 1), ["_gram", "_bands"]).where(close & near).select("_sx", "_sy")


def similar(left: DataFrame, a: str, right: DataFrame, b: str, threshold: float = 0.8) -> DataFrame:
    """Distinct pairs of strings with a ratio over the threshold (0.8 or more), and the ratio. Null and empty strings have none.

    Runs of two characters are shared by a part of all pairs, however many there are, so many short strings meet by what is left
    when the characters that may differ are left out, which takes more rows a string, but as many for any number of others. Which it is, is
    counted for each two bands of lengths. Only what has met is compared in Python. No true pair is lost."""

    def strings(df: DataFrame, c: str) -> DataFrame:
        return checkpointed(df.select(F.col(c).alias("_s")).where(F.coalesce(c, F.lit("")) != "").distinct())

    ship(left.sparkSession)
    xs, ys = shaped(strings(left, a), strings(right, b))
    meeting = Meeting(shapes(xs, ys), threshold)
    ways = [met(xs, ys, meeting, threshold) for met, known in ((met_by_left, meeting.lefts), (met_by_runs, meeting.runs)) if known[0]]
    met = reduce(DataFrame.union, ways or [xs.select(F.col("_s").alias("_sx"), F.col("_s").alias("_sy")).limit(0)])
    pairs = met.select(F.col("_sx").alias(a), F.col("_sy").alias(b)).distinct()
    # not to be moved before the pairs are distinct, nor computed again by the filter
    return pairs.withColumn("ratio", similarity.asNondeterministic()(F.col(a), F.col(b))).where(F.col("ratio") > threshold)


def by_name(paths: DataFrame, key: str, path: str, cards: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """key and value of the card whose name is similar to the first such part of the path; then by `order`."""
    segments = paths.select(key, F.posexplode(parts(F.lower(path))).alias("_pos", "_segment"))
    named = cards.select(F.lower(name).alias("_name"), F.col(order).alias("_order"), F.col(value).alias(value))
    # a row a name, and one a part: however many cards have the name, or names are like the part
    first = named.groupBy("_name").agg(F.min(F.struct("_order", value)).alias("_card"))
    pairs = similar(segments, "_segment", named, "_name").select("_segment", "_name")
    best = pairs.hint("merge").join(first, "_name").groupBy("_segment").agg(F.min("_card").alias("_card"))
    # by the hash too, so that both sides are dealt anew and adaptive execution can split parts that most paths have
    hashed = lambda df: df.withColumn("_at", F.xxhash64("_segment"))
    return hashed(segments).hint("merge").join(hashed(best), ["_segment", "_at"]).groupBy(key).agg(F.min_by(f"_card.{value}", F.struct("_pos", "_card._order")).alias(value))


def resolved(paths: DataFrame, key: str, path: str, cards: DataFrame, aliases: DataFrame, names: bool = True) -> DataFrame:
    """key, project_code, confidence and method of every path (null where none is found). `cards` has project_code, name,
    root_path and ordinal; `aliases` has project_code, alias and ordinal. The first way that finds a project wins; without
    `names`, similar names aren't looked for."""
    rows = paths.select(key, path)
    ways = (
        (1.0, "root_path", by_prefix(rows, key, path, cards, "root_path", "ordinal", "project_code")),
        (0.95, "project_number", by_code(rows, key, path, cards, "project_code")),
        (0.85, "alias_match", by_alias(rows, key, path, aliases, "alias", "ordinal", "project_code")),
    )
    named = lambda level, method, df: df.select(key, F.struct(F.col("project_code"), F.lit(level).alias("confidence"), F.lit(method).alias("method")).alias("_f"))
    every = reduce(DataFrame.unionByName, (named(*way) for way in ways))
    sure = every.groupBy(key).agg(F.max_by("_f", "_f.confidence").alias("_f"))
    known = rows.join(sure, key, "left")
    if not names:
        return known.select(key, "_f.project_code", "_f.confidence", "_f.method")
    # the dear comparison of names is for the rest only, which is read several times, and the other ways are gone once
    known = checkpointed(known.select(key, F.when(F.col("_f").isNull(), F.col(path)).alias(path), "_f"))
    rest = known.where("_f IS NULL").select(key, path)
    like = named(0.70, "fuzzy_name", by_name(rest, key, path, cards, "name", "ordinal", "project_code")).withColumnRenamed("_f", "_g")
    out = known.select(key, "_f").join(like, key, "left").withColumn("_f", F.coalesce("_f", "_g"))
    return out.select(key, "_f.project_code", "_f.confidence", "_f.method")


def nearest_override(paths: DataFrame, key: str, path: str, overrides: DataFrame, folder: str, value: str, depth: int = 12) -> DataFrame:
    """key and value of the override in the nearest of the path's folders, at most `depth` levels up. Each folder is looked up once,
    however many paths lie in it. Its levels are more rows than their table's size tells, so they are merged, never broadcast."""
    ps = F.split(path, "/")
    rows = paths.select(key, F.array_join(F.slice(ps, 1, F.size(ps) - 1), "/").alias("__lodefall_folder"))
    level = F.transform(F.sequence(F.lit(0), F.least(F.size("_ps"), F.lit(depth)) - 1), lambda i: F.array_join(F.slice("_ps", F.lit(1), F.size("_ps") - i), "/"))
    up = rows.select("__lodefall_folder").distinct().withColumn("_ps", F.split("__lodefall_folder", "/")).select("__lodefall_folder", F.posexplode(level).alias("_depth", folder))
    given = F.struct(F.col("_depth"), F.col(value).alias("value"))
    nearest = up.hint("merge").join(overrides.select(folder, value), folder).groupBy("__lodefall_folder").agg(F.min_by(given, "_depth").alias("_given"))
    return rows.hint("merge").join(nearest, "__lodefall_folder").groupBy(key).agg(F.min_by("_given.value", "_given._depth").alias(value))


def typologies(paths: DataFrame, key: str, path: str, keywords: dict[str, tuple[str, ...]], overrides: DataFrame, folder: str = "folder", value: str = "typology") -> DataFrame:
    """key and typology: what the nearest folder with an override says; where it says none, or no folder has one, by keywords."""
    given = nearest_override(paths, key, path, overrides, folder, value).withColumnsRenamed({key: "__lodefall_key", value: "__lodefall_value"})
    found = facts.typology(F.col(path), keywords)
    return paths.join(given, F.col(key) == F.col("__lodefall_key"), "left").select(key, F.coalesce("__lodefall_value", found).alias("typology"))


def title(name: Column) -> Column:
    """A readable title: without extension and a short leading prefix, separators as blanks."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(stem, r"(?U)^\w{0,6}[-_.\s]+", "")), "[-_]+", " "))
    return F.when(bare == "", stem).otherwise(bare)


def path_tokens(path: Column) -> Column:
    """The nearest three folders and the words of the file's stem, in lower case."""
    ps = F.transform(parts(path), F.lower)
    folders = F.reverse(F.slice(ps, F.greatest(F.size(ps) - 3, F.lit(1)), F.least(F.size(ps) - 1, F.lit(3))))
    return F.concat(folders, F.filter(F.split(F.regexp_replace(F.element_at(ps, -1), r"(?<=.)\.[^.]*$", ""), r"[-_.\s]+"), lambda x: x != ""))


def project_aliases(code: Column, name: Column) -> Column:
    """Initials, words of 3 characters and more, the joined name and the code's number; distinct but for case."""
    ws = F.filter(F.split(name, r"[\s\-]+"), lambda w: (w != "") & ~F.lower(w).isin(*COMMON))
    several = lambda c: F.when(F.size(ws) >= 2, F.array(c)).otherwise(F.array().cast("array<string>"))
    number = F.regexp_extract(code, "[0-9]{3,4}", 0)
    initials = F.array_join(F.transform(ws, lambda w: F.upper(F.substring(w, 1, 1))), "")
    joined = F.array_join(F.transform(ws, F.initcap), "")
    every = F.concat(several(initials), F.filter(ws, lambda w: F.length(w) >= 3), several(joined), F.filter(F.array(number), lambda n: n != ""))
    lowered = F.transform(every, F.lower)
    distinct = F.filter(every, lambda x, i: (F.array_position(lowered, F.lower(x)) == i + 1) & (F.length(x) >= 2))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(distinct)
