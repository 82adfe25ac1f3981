"""Entity resolution of demand titles: exact, fuzzy, tf-idf and vector matching.

Everything works on distinct titles first, so a title that many rows share costs
as much as one row, and each stage keys its shuffle on something finer than the
text it compares.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicpulse.functions import scalars as S
from topicpulse.operators import components
from topicpulse.session import saved

_EPS = 1e-9
# Scores are rounded to nine digits, so equal ones may differ by less than this before.
_TIE = 1e-8


# --- similarity -------------------------------------------------------------


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per character."""
    place: dict[str, int] = {}
    for i, ch in enumerate(a):
        place[ch] = place.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & place.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
        else:
            size = len(x) + len(y)
            out.append(2.0 * _common_subsequence(x, y) / size if size else 1.0)
    return pd.Series(out, dtype="float64")


def indel_ratio(a: Column, b: Column) -> Column:
    """``2 * LCS / (len a + len b)``; two empty texts are equal."""
    return _ratio(a, b)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """A cheap necessary test for ``indel_ratio(a, b) >= threshold``.

    Insertions and deletions alone never need fewer steps than edits with
    substitutions, so the bounded edit distance inside the JVM prunes without loss.
    """
    steps = F.floor((1 - threshold) * (F.length(a) + F.length(b)) + _EPS).cast("int")
    return F.call_function("levenshtein", a, b, steps) >= 0


def unit_vector(v: Column) -> Column:
    """Scale a number array to length one; NULL for a zero vector."""
    doubles = F.transform(v, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return S.bind(F.struct(doubles.alias("v"), length.alias("n")), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])))


def vector_length(v: Column) -> Column:
    """Euclidean length of a number array in double precision; NULL where a component is."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, length_a: Column, length_b: Column) -> Column:
    """Cosine of two number arrays of equal size, given their lengths."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x) / (length_a * length_b)


# --- exact ------------------------------------------------------------------


def distinct_titles(library: DataFrame) -> DataFrame:
    """``(title, id)``: every title once, with its lowest id."""
    return library.groupBy("title").agg(F.min("id").alias("id"))


def exact_match(new: DataFrame, library: DataFrame) -> DataFrame:
    """``(query_id, existing_id)`` for titles the library already has."""
    known = distinct_titles(library).withColumnRenamed("id", "existing_id")
    return new.select("query_id", "title").join(known, "title").select("query_id", "existing_id")


# --- fuzzy ------------------------------------------------------------------


def _tokens(title: Column) -> Column:
    """Characters with their occurrence number, so that a text is a set of tokens."""
    chars = F.split(title, "")
    return F.flatten(
        F.transform(
            F.array_distinct(chars),
            lambda c: F.transform(
                F.sequence(F.lit(1), F.size(F.filter(chars, lambda x: x == c))),
                lambda k: F.concat(c, k.cast("string")),
            ),
        )
    )


def _signatures(titles: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """``(sig, pos, key, text, len)``: pairs of rare tokens every similar title shares.

    For a ratio of at least t, two texts share at least ``t (la + lb) / 2`` tokens,
    hence at least ``t la / (2 - t)``. Sorted by rarity, their first
    ``la - that + 2`` tokens then have two tokens in common.
    """
    need = F.ceil(threshold * F.col("len") / (2 - threshold) - _EPS).cast("int")
    rare_first = (
        titles.select("key", "text", "len", F.explode("tokens").alias("token"))
        .join(frequency, "token")
        .groupBy("key", "text", "len")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))
    )
    # The empty text has no token to be found by.
    head = F.slice("ts.token", 1, F.least(F.col("len"), F.greatest(F.col("len") - need + 2, F.lit(1))))
    prefixed = rare_first.select("key", "text", "len", head.alias("p"))
    n = F.size("p")
    p = F.col("p")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda i: F.transform(
                F.sequence(i + 1, n - 1),
                lambda j: F.struct(F.xxhash64(F.get(p, i), F.get(p, j)).alias("sig"), j.alias("pos"), F.lit(2).alias("l")),
            ),
        )
    )
    singles = F.transform(
        p, lambda x, i: F.struct(F.xxhash64(F.lit("1"), x).alias("sig"), i.cast("int").alias("pos"), F.lit(1).alias("l"))
    )
    # Very short texts may share a single token only.
    short = int(((2 - threshold) / threshold) ** 2)
    none = F.slice(singles, 1, 0)
    sigs = F.concat(
        F.when(n >= 2, pairs).otherwise(none), F.when(F.col("len") <= short, singles).otherwise(none)
    )
    return prefixed.select("key", "text", "len", F.explode(sigs).alias("s")).select("key", "text", "len", "s.*")


def _prepared(titles: DataFrame) -> DataFrame:
    return titles.select(
        F.xxhash64("title").alias("key"), F.col("title").alias("text"), F.length("title").alias("len"), _tokens(F.col("title")).alias("tokens")
    )


def _places_allow(threshold: float) -> Column:
    """Whether lengths and places of a shared signature leave room for enough common tokens."""
    la, lb = F.col("la"), F.col("lb")
    need = threshold * (la + lb) / 2 - _EPS
    return (F.least(la, lb) >= need) & (F.col("l") + F.least(la - 1 - F.col("pa"), lb - 1 - F.col("pb")) >= need)


def similar_titles(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All distinct title pairs ``(a, b, ratio)`` with ratio >= threshold, without loss.

    Pairs meet on a signature, and must pass the length, position and edit-distance
    bounds inside the join, so that only near matches leave it.
    """
    a, b = _prepared(left.select("title").distinct()), _prepared(right.select("title").distinct())
    both = a.unionByName(b).select(F.explode("tokens").alias("token"))
    frequency = both.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    sa = _signatures(a, frequency, threshold).select(
        "sig", "l", F.col("text").alias("a"), F.col("len").alias("la"), F.col("pos").alias("pa")
    )
    sb = _signatures(b, frequency, threshold).select(
        "sig", "l", F.col("text").alias("b"), F.col("len").alias("lb"), F.col("pos").alias("pb")
    )
    near = _places_allow(threshold) & may_reach(F.col("a"), F.col("b"), threshold)
    pairs = sa.join(sb, ["sig", "l"]).where(near).select("a", "b").distinct()
    return pairs.withColumn("ratio", indel_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= threshold - _EPS)


def fuzzy_best_match(new: DataFrame, library: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(query_id, existing_id, ratio)``: the most similar library title, lowest id first."""
    known = distinct_titles(library)
    asked = new.select("title").distinct()
    same = asked.join(known, "title").select(F.col("title").alias("a"), "id", F.lit(1.0).alias("ratio"))
    others = similar_titles(asked.join(known, "title", "left_anti"), known, threshold)
    scored = others.join(known.withColumnRenamed("title", "b"), "b").select("a", "id", "ratio")
    best = (
        scored.unionByName(same)
        .groupBy("a")
        .agg(F.max(F.struct(F.col("ratio"), (-F.col("id")).alias("back"))).alias("m"))
        .select(F.col("a").alias("title"), (-F.col("m.back")).alias("existing_id"), F.col("m.ratio").alias("ratio"))
    )
    return new.select("query_id", "title").join(best, "title").select("query_id", "existing_id", "ratio")


# --- tf-idf -----------------------------------------------------------------


def words(title: Column) -> Column:
    """Lower-case words of two or more characters; Chinese runs give character pairs."""
    t = F.lower(title)
    plain = F.regexp_extract_all(t, F.lit(r"(?U)[\w&&[^一-鿿]]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit(r"[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(
        F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    )
    return F.concat(plain, pairs)


def tfidf_vectors(
    new: DataFrame, library: DataFrame, fitted: DataFrame | None = None, tokenize=words
) -> tuple[DataFrame, DataFrame]:
    """Weight rows ``(title, token, w, titles)`` of the new and the library titles.

    Smooth idf fitted once over the library rows and the ``fitted`` rows (the new ones
    by default), raw term counts, unit length vectors. ``titles`` is the number of
    library titles holding the token.
    """

    def counted(frame: DataFrame) -> DataFrame:
        copies = frame.groupBy("title").agg(F.count(F.lit(1)).alias("copies"))
        terms = copies.select("title", "copies", F.explode(tokenize(F.col("title"))).alias("token"))
        return terms.groupBy("title", "copies", "token").agg(F.count(F.lit(1)).alias("tf"))

    other = new if fitted is None else fitted
    held, asked = counted(library), counted(new)
    rows = held.select("token", "copies", F.lit(1).alias("one")).unionByName(
        (asked if fitted is None else counted(other)).select("token", "copies", F.lit(0).alias("one"))
    )
    total = library.agg(F.count(F.lit(1)).alias("n")).scalar() + other.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.ln((1 + total) / (1 + F.sum("copies"))) + 1
    table = rows.groupBy("token").agg(idf.alias("idf"), F.sum("one").alias("titles"))

    def weighted(terms: DataFrame) -> DataFrame:
        raw = terms.join(table, "token").select("title", "token", "titles", (F.col("tf") * F.col("idf")).alias("v"))
        # One vector is as long as one title, so a window per title stays small.
        norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("title")))
        return raw.select("title", "token", "titles", (F.col("v") / norm).alias("w"))

    return weighted(asked), weighted(held)


def _level(weight: Column) -> Column:
    """Blocks of a posting list: half powers of two, the heaviest weights first."""
    return F.least(F.greatest(F.floor(-2 * F.log2(weight)), F.lit(0)), F.lit(60)).cast("int")


def _reach(asked: DataFrame, span: DataFrame, bar: DataFrame) -> DataFrame:
    """``(a, token, floor, lo, hi)``: the least weight at which a posting can lead to the bar.

    A query's tokens are put in order of the most they can add. The first ones that stay below
    the bar together need no posting at all. What is left of the bar is dealt to the other
    tokens in proportion to their weights: a title that lies below the floor at every token
    scores less than the bar.
    """
    query = W.partitionBy("a")
    ladder = query.orderBy("most", "token").rowsBetween(W.unboundedPreceding, 0)
    # A query's rows are the tokens of one title.
    rows = asked.join(span, "token").join(bar, "a", "left").withColumn("most", F.col("wa") * F.col("peak"))
    idle = F.coalesce(F.sum("most").over(ladder) < F.col("bar") - _TIE, F.lit(False))
    busy = rows.withColumn("idle", idle)
    left = F.col("bar") - _TIE - F.sum(F.when(F.col("idle"), F.col("most")).otherwise(0.0)).over(query)
    mass = F.sum(F.when(F.col("idle"), 0.0).otherwise(F.col("wa") * F.col("wa"))).over(query)
    floors = busy.withColumn("floor", F.coalesce(left * F.col("wa") / mass, F.lit(0.0)))
    return floors.where(~F.col("idle") & (F.col("floor") <= F.col("peak"))).select(
        "a", "token", "floor", _level(F.col("peak")).alias("lo"), _level(F.greatest("floor", "least")).alias("hi")
    )


def tfidf_candidates(
    new: DataFrame,
    library: DataFrame,
    top: int = 20,
    heads: int | None = None,
    fitted: DataFrame | None = None,
    tokenize=words,
) -> DataFrame:
    """The ``top`` library rows per new row by tf-idf cosine: ``(query_id, candidate_id, score, rank)``.

    Ties go to the higher id; rows without a common token are no candidates. The heaviest
    ``heads`` postings of each token (``top`` by default) give every query a first list, whose
    last score is its bar. Then only blocks of postings are read whose weights can lead to the
    bar (:func:`_reach`), and titles met there are scored over their whole vectors. So the
    result is exact, and a token that most titles hold is read as far as a query needs it.
    Titles that tie at the bar are all read.
    """
    q, d = (saved(v) for v in tfidf_vectors(new, library, fitted, tokenize))
    asked = q.select(F.col("title").alias("a"), "token", F.col("w").alias("wa"))
    held = d.select(F.col("title").alias("b"), "token", F.col("w").alias("wb"))
    ids = library.groupBy("title").agg(F.max("id").alias("max_id")).withColumnRenamed("title", "b")
    vector_q = asked.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("token", "wa"))).alias("va"))
    vector_d = saved(held.groupBy("b").agg(F.collect_list(F.struct("token", "wb")).alias("vb")).join(ids, "b"))
    product = F.aggregate(
        "vb", F.lit(0.0), lambda acc, x: acc + x["wb"] * F.coalesce(F.try_element_at(F.col("va"), x["token"]), F.lit(0.0))
    )

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(vector_d, "b").join(vector_q, "a")
        return both.select("a", "b", "max_id", F.round(product, 9).alias("score"))

    def best(found: DataFrame) -> DataFrame:
        ranked = W.partitionBy("a").orderBy(F.desc("score"), F.desc("max_id"))
        return found.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= top).drop("r")

    heaviest = W.partitionBy("token").orderBy(F.desc("wb"), "b")
    head = held.withColumn("r", F.row_number().over(heaviest)).where(F.col("r") <= (heads or top)).select("token", "b")
    first = saved(best(scored(asked.join(head, "token").select("a", "b").distinct())))
    bar = first.groupBy("a").agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).alias("bar"))
    span = held.groupBy("token").agg(F.max("wb").alias("peak"), F.min("wb").alias("least"))
    wanted = _reach(asked, span, bar).select("a", "token", "floor", F.explode(F.sequence("lo", "hi")).alias("level"))
    blocks = held.withColumn("level", _level(F.col("wb")))
    met = wanted.join(blocks, ["token", "level"]).where(F.col("wb") >= F.col("floor")).select("a", "b").distinct()
    chosen = best(first.unionByName(scored(met.join(first.select("a", "b"), ["a", "b"], "left_anti"))))

    newest = W.partitionBy("title").orderBy(F.desc("id"))
    rows = library.select("id", "title").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= top)
    expanded = chosen.select("a", "b", "score").join(rows.select(F.col("title").alias("b"), "id"), "b")
    order = W.partitionBy("a").orderBy(F.desc("score"), F.desc("id"))
    picked = expanded.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    found = new.select("query_id", F.col("title").alias("a")).join(picked, "a")
    return found.select("query_id", F.col("id").alias("candidate_id"), "score", "rank")


def title_candidates(asked: DataFrame, new: DataFrame, library: DataFrame, top: int = 20, heads: int | None = None) -> DataFrame:
    """``(title, candidate_id, score, rank)`` of the titles of ``asked``, each asked once.

    Candidates depend on the title alone; the weights are those of all ``new`` rows.
    """
    titles = saved(asked.select(F.col("title").alias("query_id"), "title").distinct())
    return tfidf_candidates(titles, library, top, heads, fitted=new).withColumnRenamed("query_id", "title")


# --- vectors ----------------------------------------------------------------


def vector_scores(candidates: DataFrame, new_vectors: DataFrame, library_vectors: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``(query_id, candidate_id, similarity)`` of candidate pairs; zero vectors take no part.

    Candidates are ``(query_id, candidate_id)``, or ``(title, candidate_id)`` for the rows
    ``(query_id, title)`` of ``asked``: then a row's vector and a candidate's go through the shuffle
    once a row and once a title's candidate, and pairs are made where they meet. Vectors stay as
    narrow as they are stored, with their length beside them.
    """

    def measured(vectors: DataFrame, key: str, name: str) -> DataFrame:
        rows = vectors.select(F.col(key).alias("key"), F.col("vector").alias(f"v{name}"), vector_length(F.col("vector")).alias(f"l{name}"))
        return rows.where(F.col(f"l{name}") > 0)

    va = measured(new_vectors, "query_id", "a").withColumnRenamed("key", "query_id")
    vb = measured(library_vectors, "id", "b").withColumnRenamed("key", "candidate_id")
    if asked is None:
        pairs = candidates.select("query_id", "candidate_id").join(va, "query_id").join(vb, "candidate_id")
    else:
        known = candidates.select("title", "candidate_id").join(vb, "candidate_id")
        pairs = asked.select("query_id", "title").join(va, "query_id").join(known, "title")
    similarity = cosine(F.col("va"), F.col("vb"), F.col("la"), F.col("lb"))
    return pairs.select("query_id", "candidate_id", F.round(similarity, 6).alias("similarity"))


def semantic_match(
    candidates: DataFrame, new_vectors: DataFrame, library_vectors: DataFrame, above: float = 0.5, asked: DataFrame | None = None
) -> DataFrame:
    """Best candidate by vector cosine, if it exceeds ``above``; ties to the lowest id."""
    scored = vector_scores(candidates, new_vectors, library_vectors, asked)
    top = F.max(F.struct(F.col("similarity"), (-F.col("candidate_id")).alias("back")))
    return (
        scored.where(F.col("similarity") > above)
        .groupBy("query_id")
        .agg(top.alias("m"))
        .select("query_id", (-F.col("m.back")).alias("existing_id"), F.col("m.similarity").alias("similarity"))
    )


# --- cascade ----------------------------------------------------------------


def candidate_ratio(candidates: DataFrame, new: DataFrame, library: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Best edit ratio of each new row over its candidates, for rows that reach ``at_least``."""
    named = candidates.select("query_id", "candidate_id").join(
        new.select("query_id", F.col("title").alias("a")), "query_id"
    ).join(library.select(F.col("id").alias("candidate_id"), F.col("title").alias("b")), "candidate_id")
    near = named.select("a", "b").distinct().where(may_reach(F.col("a"), F.col("b"), at_least))
    pairs = near.withColumn("ratio", indel_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= at_least - _EPS)
    top = F.max(F.struct(F.col("ratio"), (-F.col("candidate_id")).alias("back")))
    return (
        named.join(pairs, ["a", "b"])
        .groupBy("query_id")
        .agg(top.alias("m"))
        .select("query_id", (-F.col("m.back")).alias("near_id"), F.col("m.ratio").alias("near_ratio"))
    )


def dedup_cascade(
    new: DataFrame,
    library: DataFrame,
    new_vectors: DataFrame | None = None,
    library_vectors: DataFrame | None = None,
    top: int = 20,
) -> DataFrame:
    """Exact, then fuzzy (>= 0.8), then semantic for a best ratio within (0.5, 0.8).

    One row per new demand: ``is_duplicate, existing_id, level, similarity`` and the
    inconclusive neighbour ``(near_id, near_ratio)``.
    """
    exact = exact_match(new, library).withColumnRenamed("existing_id", "exact_id")
    left = new.join(exact, "query_id", "left_anti")
    fuzzy = fuzzy_best_match(left, library).select("query_id", F.col("existing_id").alias("fuzzy_id"), "ratio")
    fuzzy = saved(fuzzy)
    rest = saved(left.join(fuzzy, "query_id", "left_anti").select("query_id", "title"))
    # Candidates and their ratios depend on the title alone, so each title is asked once.
    candidates = saved(title_candidates(rest, new, library, top))
    titles = rest.select(F.col("title").alias("query_id"), "title").distinct()
    ratios = candidate_ratio(candidates.withColumnRenamed("title", "query_id"), titles, library)
    closest = F.max(F.struct("near_ratio", (-F.col("near_id")).alias("back")))
    of_rows = rest.join(ratios.withColumnRenamed("query_id", "title"), "title").groupBy("query_id").agg(closest.alias("m"))
    near = of_rows.select("query_id", (-F.col("m.back")).alias("near_id"), F.col("m.near_ratio").alias("near_ratio"))
    near = saved(near.where("near_ratio > 0.5 AND near_ratio < 0.8"))
    out = (
        new.select("query_id")
        .join(exact, "query_id", "left")
        .join(fuzzy, "query_id", "left")
        .join(near, "query_id", "left")
    )
    if new_vectors is None or library_vectors is None:
        out = out.withColumn("semantic_id", F.lit(None).cast("bigint")).withColumn("similarity", F.lit(None).cast("double"))
    else:
        open_rows = rest.join(near.select("query_id"), "query_id", "left_semi")
        semantic = semantic_match(candidates, new_vectors, library_vectors, asked=open_rows)
        out = out.join(semantic.withColumnRenamed("existing_id", "semantic_id"), "query_id", "left")
    found = F.coalesce("exact_id", "fuzzy_id", "semantic_id")
    level = (
        F.when(F.col("exact_id").isNotNull(), "exact")
        .when(F.col("fuzzy_id").isNotNull(), "fuzzy")
        .when(F.col("semantic_id").isNotNull(), "semantic")
        .otherwise("new")
    )
    score = F.when(F.col("exact_id").isNotNull(), 1.0).otherwise(F.coalesce("ratio", "similarity"))
    return out.select(
        "query_id",
        found.isNotNull().alias("is_duplicate"),
        found.alias("existing_id"),
        level.alias("level"),
        score.alias("similarity"),
        "near_id",
        "near_ratio",
    )


def merged_tags(rows: DataFrame, key: str) -> DataFrame:
    """Sorted union of the tags of each key as JSON text; malformed tags count as none."""
    tags = rows.select(key, F.explode(S.json_list("tags")).alias("tag")).distinct()
    return tags.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list("tag"))).alias("tags"))


def merge_demands(demands: DataFrame, duplicates: DataFrame, as_of: Column) -> DataFrame:
    """Fold duplicates ``(existing_id, description, tags, ord)`` into the library.

    Frequency grows by one per duplicate, ``last_seen`` becomes ``as_of``, a strictly
    longer description wins (the first of the longest), tags are united.
    """
    size = F.length(F.coalesce("description", F.lit("")))
    gained = duplicates.groupBy(F.col("existing_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_more"),
        F.max_by("description", F.struct(size, -F.col("ord"))).alias("_desc"),
    )
    touched = gained.select("id")
    old_tags = demands.select("id", "tags").join(touched, "id", "left_semi")
    new_tags = duplicates.select(F.col("existing_id").alias("id"), "tags")
    union = merged_tags(old_tags.unionByName(new_tags), "id").withColumnRenamed("tags", "_tags")
    hit = F.col("_more").isNotNull()
    longer = F.length(F.coalesce("_desc", F.lit(""))) > F.length(F.coalesce("description", F.lit("")))
    return (
        demands.join(gained, "id", "left")
        .join(union, "id", "left")
        .withColumn("frequency", F.coalesce("frequency", F.lit(1)) + F.coalesce("_more", F.lit(0)))
        .withColumn("last_seen", F.when(hit, as_of).otherwise(F.col("last_seen")))
        .withColumn("description", F.when(longer, F.col("_desc")).otherwise(F.col("description")))
        .withColumn("tags", F.when(hit, F.coalesce("_tags", F.lit("[]"))).otherwise(F.col("tags")))
        .drop("_more", "_desc", "_tags")
    )


def relation_pairs(verdicts: DataFrame) -> DataFrame:
    """Pairs of a cascade worth an edge: semantic hits and inconclusive neighbours.

    The saved new demand keeps its ``query_id``.
    """
    semantic = F.col("level") == "semantic"
    return verdicts.where(semantic | ((F.col("level") == "new") & F.col("near_id").isNotNull())).select(
        F.when(semantic, F.col("existing_id")).otherwise(F.col("near_id")).alias("existing_id"),
        F.col("query_id").alias("new_id"),
        F.when(semantic, F.col("similarity")).otherwise(F.col("near_ratio")).alias("similarity"),
    )


def relation_edges(pairs: DataFrame, stored: DataFrame, above: float = 0.5) -> DataFrame:
    """New undirected edges ``(demand_id_a < demand_id_b, similarity_score)``.

    From ``(existing_id, new_id, similarity)``; weak pairs, unsaved demands and pairs
    stored before are left out, and the strongest of a repeated pair counts.
    """
    keys = ["demand_id_a", "demand_id_b"]
    edges = pairs.where((F.col("similarity") > above) & F.col("new_id").isNotNull()).select(
        F.least("existing_id", "new_id").alias(keys[0]),
        F.greatest("existing_id", "new_id").alias(keys[1]),
        F.col("similarity").alias("similarity_score"),
    )
    once = edges.groupBy(*keys).agg(F.max("similarity_score").alias("similarity_score"))
    return once.join(stored.select(*keys), keys, "left_anti")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, leader)``: the lowest id reachable over undirected ``(a, b)`` edges."""
    roots = components.connected_components(edges)
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("leader"))


def _signed(titles: DataFrame, threshold: float) -> DataFrame:
    """``(sig, l, pos, id, text, len)`` of titles ``(title, id)``."""
    prepared = titles.select(
        F.col("id").alias("key"), F.col("title").alias("text"), F.length("title").alias("len"), _tokens(F.col("title")).alias("tokens")
    )
    frequency = prepared.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return _signatures(prepared, frequency, threshold).withColumnRenamed("key", "id")


def _side(rows: DataFrame, n: str) -> DataFrame:
    """Signature rows with the columns of one side of a pair; ``star`` where there is one."""
    star = [F.col("star").alias(f"s{n}")] if "star" in rows.columns else []
    names = {"id": f"i{n}", "text": n, "len": f"l{n}", "pos": f"p{n}"}
    return rows.select("sig", "l", *[F.col(k).alias(v) for k, v in names.items()], *star)


def star_links(signed: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)`` of titles to similar centres, at most two a title.

    The lowest and the highest id of the rows that share a signature are its centres; a
    title is linked to the lowest and the highest of the centres that it reaches.
    """
    row = F.struct("id", "text", "len", "pos")
    ends = signed.groupBy("sig", "l").agg(F.min(row).alias("lo"), F.max(row).alias("hi")).where("lo.id < hi.id")
    centres = ends.select("sig", "l", F.explode(F.array("lo", "hi")).alias("c")).select("sig", "l", "c.*")
    met = _side(signed, "a").join(_side(centres, "b"), ["sig", "l"])
    # Many signatures lead to one centre: the costly test comes once a pair.
    pairs = met.where((F.col("ia") != F.col("ib")) & _places_allow(threshold)).select("ia", "ib", "a", "b").distinct()
    close = pairs.where(may_reach(F.col("a"), F.col("b"), threshold)).withColumn("ratio", indel_ratio(F.col("a"), F.col("b")))
    reached = close.where(F.col("ratio") >= threshold - _EPS).groupBy("ia").agg(F.min("ib").alias("lo"), F.max("ib").alias("hi"))
    return reached.select(F.col("ia").alias("a"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("b"))


def links_across(signed: DataFrame, stars: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)``, a < b, between stars ``(id, star)`` that hold similar titles.

    Titles of one star never meet. Where a star has a single row under a signature, the row
    meets those of the other stars; stars with more rows there meet as stars first, and their
    rows only with the rows of another star.
    """
    rows = signed.join(stars, "id")
    key = ["sig", "l", "star"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("sig", "l").agg(F.min("star").alias("x"), F.max("star").alias("y")).where("x < y")
    kinds = counts.join(mixed, ["sig", "l"], "left_semi").select(*key, (F.col("n") > 1).alias("crowd"))
    rows = saved(rows.join(kinds, key))
    alone, crowds = rows.where("NOT crowd"), rows.where("crowd")
    near = _places_allow(threshold) & may_reach(F.col("a"), F.col("b"), threshold)
    on = ["sig", "l"]
    single = _side(alone, "a").join(_side(alone, "b"), on).where((F.col("sa") < F.col("sb")) & near)
    one_many = _side(alone, "a").join(_side(crowds, "b"), on).where((F.col("sa") != F.col("sb")) & near)
    names = crowds.select(*key).distinct()
    meeting = names.withColumnRenamed("star", "sa").join(names.withColumnRenamed("star", "sb"), on).where("sa < sb")
    many = meeting.join(_side(crowds, "a"), [*on, "sa"]).join(_side(crowds, "b"), [*on, "sb"]).where(near)
    columns = ["a", "b", "sa", "sb"]
    pairs = single.select(*columns).unionByName(one_many.select(*columns)).unionByName(many.select(*columns)).distinct()
    similar = pairs.withColumn("ratio", indel_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= threshold - _EPS)
    return similar.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct()


def duplicate_clusters(library: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(id, leader)``: rows joined by chains of similar titles, led by the lowest id.

    Titles are linked to centres first, and the stars that follow are compared with each
    other only, so a group of like titles costs a few links a title and not all its pairs.
    """
    known = saved(distinct_titles(library))
    signed = saved(_signed(known, threshold))
    stars = connected_components(known, star_links(signed, threshold)).withColumnRenamed("leader", "star")
    roots = components.connected_components(links_across(signed, stars, threshold))
    led = stars.join(roots.withColumnRenamed("id", "star"), "star", "left").select("id", F.coalesce("root", "star").alias("leader"))
    by_title = known.join(led, "id").select("title", "leader")
    return library.select("id", "title").join(by_title, "title").select("id", "leader")
