"""Entity resolution without a shared key: records of one person, org or thing under differing names.

Records meet by what few of them share, are compared field by field, and a pair's patterns of agreement are weighed by
Fellegi and Sunter's model, whose probabilities expectation-maximisation learns from the pairs themselves. Records linked
by probable pairs, over any number of steps, are one entity. A record that lacks a field and could be either of two that differ in
it goes with the closer by name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.shared import stash, unstash

#: Records that a block may have; larger ones are divided by what else their records have.
BLOCK = 50
#: Frequent things that are taken together to make a block, at most.
TOGETHER = 4
#: Fields besides the name, so that the patterns of agreement stay few (4 * 3 ** fields).
MOST_FIELDS = 8
ROUNDS = 200
#: How often names of a match have each level of agreement, from 0 to 3.
NAMES = (0.05, 0.1, 0.25, 0.6)
#: Records whose pairs are all looked at, to see how often names have a level by chance; and hits from which that is taken as known.
SAMPLE, HITS = 2000, 10
#: How far apart names are that are not a few edits apart.
FAR = 3
#: Pairs that the starting probabilities count as, so that few pairs don't unsettle them.
PRIOR = 2


def records(rows: DataFrame, key: str, name: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, tokens, f0, f1, ...): a name's words in order, lower-cased, and fields as text, blank ones null. Rows without a key are left out."""
    if len(fields) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")))
    own = (F.nullif(F.lower(F.trim(F.col(f).cast("string"))), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields))
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), words.alias("tokens"), *own)


def blocks(recs: DataFrame, n_fields: int, most: int = BLOCK) -> DataFrame:
    """(a, b): pairs of records that share a word or a field's value that at most `most` records have, or up to TOGETHER frequent ones that so few have together, or have words one edit apart.

    Words one edit apart are alike once each has lost a character or none; such a spelling makes a block if at most `most` records have it. No other block is cut; one with more records is divided by a further thing that its records have, and ends unused only if they have none.
    """
    values = [F.when(F.col(f"f{i}").isNotNull(), F.concat(F.lit(f"{i}:"), f"f{i}")) for i in range(n_fields)]
    things = F.concat(F.transform("tokens", lambda w: F.concat(F.lit("n:"), w)), F.array_compact(F.array(*values).cast("array<string>")))
    have = stash(recs.select("id", F.explode(things).alias("x")), "have")
    sets, frequent, made, used = have.select("id", F.array("x").alias("s")), None, [], []
    for size in range(1, TOGETHER + 1):
        if size > 1:
            sets = sets.join(frequent, "id").where(F.col("x") > F.element_at("s", -1)).select("id", F.array_append("s", F.col("x")).alias("s"))
        counts = sets.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
        sized = stash(sets.join(counts, "s"), "blocks")
        used.append(sized)
        made.append(sized.where(F.col("n") <= most).select("id", "s"))
        sets = sized.where(F.col("n") > most).select("id", "s")
        if size == 1:
            frequent = sets.select("id", F.col("s")[0].alias("x"))
    spellings = F.flatten(F.transform("tokens", lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))))
    near = recs.select("id", F.explode(F.array_distinct(spellings)).alias("x")).where("x <> ''").select("id", F.array(F.concat(F.lit("~:"), "x")).alias("s"))
    made.append(near.join(near.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("s"), "s").select("id", "s"))
    own = made[0]
    for more in made[1:]:
        own = own.unionAll(more)
    pairs = stash(own.select(F.col("id").alias("a"), "s").join(own.select(F.col("id").alias("b"), "s"), "s").where("a < b").select("a", "b").distinct(), "pairs")
    unstash(have, *used)
    return pairs


def _edits() -> Column:
    """Edits between the names of x and y, if they are two at most, an edit in five characters and none in digits; else null. Words that both have are left out as well, as a misspelt word may have another place in the order."""
    a, b = F.col("x.tokens"), F.col("y.tokens")
    shorter = F.least(*(F.length(F.array_join(w, " ")) for w in (a, b)))
    ways = []
    for words in ((a, b), (F.array_except(a, b), F.array_except(b, a))):
        texts = [F.array_join(w, " ") for w in words]
        edits, digits = F.levenshtein(*texts, 2), [F.regexp_replace(x, r"\D", "") for x in texts]
        ways.append(F.when((edits >= 0) & (5 * edits <= shorter) & (digits[0] == digits[1]), edits))
    return F.least(*ways)


def _agreement(n_fields: int) -> list[Column]:
    """Columns g0 (the name: 3 the same words, 2 few edits apart (`_edits`), or all words of the shorter, 1 half of the words, else 0) and per field 1, 0 or, where one is missing, -1."""
    a, b = F.col("x.tokens"), F.col("y.tokens")
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    shorter = F.least(F.size(a), F.size(b))
    levels = F.when(shorter == 0, -1).when(both == all_, 3).when(_edits().isNotNull() | (both == shorter), 2).when(2 * both >= all_, 1).otherwise(0)
    return [levels.alias("g0"), *(F.coalesce((F.col(f"x.f{i}") == F.col(f"y.f{i}")).cast("int"), F.lit(-1)).alias(f"g{i + 1}") for i in range(n_fields))]


def _rising(shares: np.ndarray) -> np.ndarray:
    """The nearest shares that don't fall from level to level: neighbours that do are levelled."""
    pools: list[list[float]] = []
    for v in shares:
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v, n = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + v * n) / (pools[-1][1] + n), pools[-1][1] + n]
    return np.repeat([v for v, _ in pools], [int(n) for _, n in pools])


def chances(recs: DataFrame, n_fields: int) -> np.ndarray:
    """For each field, how often two records that have it agree, over all pairs of records."""
    found = [(0, 0)] * n_fields
    if n_fields:
        each = recs.select(F.posexplode(F.array(*(F.col(f"f{i}") for i in range(n_fields)))).alias("i", "v")).where("v is not null")
        sizes = each.groupBy("i", "v").agg(F.count("*").cast("double").alias("n")).groupBy("i")
        for r in sizes.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), F.sum("n").alias("n")).collect():  # a row a field
            found[r["i"]] = r["same"], r["n"] * (r["n"] - 1)
    return np.array([(same + 1) / (all_ + 2) for same, all_ in found])


def levels_by_chance(reps: DataFrame, n_fields: int) -> tuple[np.ndarray, int]:
    """(how many pairs of names have each level, how many pairs there are) among SAMPLE records, picked by a hash of their keys; all records if there are no more."""
    own = stash(reps.where(F.size("tokens") > 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "tokens", *(f"f{i}" for i in range(n_fields))), "sample")
    cols = [c for c in own.columns if c != "id"]
    x, y = (own.select(F.col("id").alias(k), F.struct(*cols).alias(v)) for k, v in (("a", "x"), ("b", "y")))
    pairs = x.repartition(32, "a").join(F.broadcast(y), F.col("a") < F.col("b"))
    found = np.zeros(4)
    for r in pairs.select(_agreement(n_fields)[0]).groupBy("g0").count().collect():  # a row a level
        found[r["g0"]] = r["count"]
    unstash(own)
    return found, int(found.sum())


def fit(patterns: np.ndarray, counts: np.ndarray, chance: np.ndarray, names: np.ndarray | None = None, total: float | None = None) -> np.ndarray:
    """The probability of a match for each pattern (levels, -1 where something is missing), by expectation-maximisation over their counts.

    names, total: how many of all pairs of records have each level of the name, and how many pairs there are, of which those counted are the ones
    that met. A block's pairs agree on what made it, so that as records grow in number a block's chance pairs outdo what the fields' chances
    say; the pairs that didn't meet are no matches, and count with the rest. Without these, the pairs counted are taken for all.

    Fields are taken to agree independently of each other among matches and among the rest. Two probabilities are given, as pairs that met in a
    block agree on what made it, matches or not, and would be taken for matches of another kind: among the rest, fields agree by `chance`, as
    all pairs of records do; among matches, names have the levels NAMES. Learnt are how often a field agrees among matches (at least in
    half of them), how often the rest's names have each level (a higher one never more often), and the share of matches.
    """
    n_levels = [4, *([2] * len(chance))]
    m = [np.array(NAMES), *(np.array([0.1, 0.9]) for _ in chance)]
    u = [np.array([0.98, 0.016, 0.002, 0.002]), *(np.array([1 - c, c]) for c in chance)]
    start, share = [u[0], *m[1:]], 0.1
    if names is not None:
        u[0], share = names + PRIOR * start[0], share * counts.sum() / total
        u[0] = _rising((u[0] / u[0].sum())[::-1])[::-1]
    for _ in range(ROUNDS):
        odds = np.full(len(counts), np.log(share) - np.log1p(-share))
        for j in range(len(n_levels)):
            there = patterns[:, j] >= 0
            odds[there] += (np.log(m[j]) - np.log(u[j]))[patterns[there, j]]
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        for j, n in enumerate(n_levels):
            there = patterns[:, j] >= 0
            seen = np.bincount(patterns[there, j], ((p if j else 1 - p) * counts)[there], n)
            if names is not None and not j:
                seen = np.maximum(names - np.bincount(patterns[there, j], (p * counts)[there], n), 0)
            seen = seen + PRIOR * start[j]
            seen = seen / seen.sum()
            if j:
                m[j] = _rising(seen)
            else:
                u[0] = _rising(seen[::-1])[::-1]
        share = (p @ counts + 0.5) / ((total or counts.sum()) + 1)
    return p


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id that links (a, b) lead to, however far, for all ids that links have.

    A round takes the least root among an id's neighbours, then the root of that root, so chains close in few rounds; each round is
    written to the shared folder.
    """
    ways = stash(links.select("a", "b").unionAll(links.select("b", "a")).distinct(), "ways")
    at = stash(ways.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "roots")
    while True:
        near = ways.join(at.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("_near"))
        moved = at.join(near, "id").select("id", F.col("root").alias("_was"), F.least("root", "_near").alias("_r"))
        jump = at.select(F.col("id").alias("_r"), F.col("root").alias("_far"))
        last, at = at, stash(moved.join(jump, "_r", "left").select("id", "_was", F.coalesce(F.least("_far", "_r"), "_r").alias("root")), "roots")
        changed = at.where("root <> _was").limit(1).count()
        unstash(last)
        at = at.drop("_was") if changed else at
        if not changed:
            unstash(ways)
            return at.select("id", "root")


def settled(links: DataFrame, recs: DataFrame, n_fields: int) -> DataFrame:
    """`links` (a, b, far) but those that would make one of records known to differ: a record that lacks a field, and is linked to records that differ in it, keeps its closest by name (least `far`), all that are equally close."""
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("other"), "far").unionAll(links.select("b", "a", "far"))
    ends = stash(ends.join(ends.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "id"), "ends")
    lacks = ends.join(recs.select("id", *(F.col(f"f{i}").isNull().alias(f"_{i}") for i in range(n_fields))), "id")
    both = lacks.join(recs.select(F.col("id").alias("other"), *(f"f{i}" for i in range(n_fields))), "other")
    differ = F.lit(False)
    for i in range(n_fields):
        seen = F.when(F.col(f"_{i}"), F.col(f"f{i}"))
        differ = differ | F.coalesce(F.min(seen) < F.max(seen), F.lit(False))
    closest = both.groupBy("id").agg(F.min("far").alias("_least"), differ.alias("_differ")).where("_differ")
    gone = ends.join(closest, "id").where("far > _least").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    kept = stash(links.join(gone, ["a", "b"], "left_anti").select("a", "b"), "links")
    unstash(ends)
    return kept


def resolve(rows: DataFrame, key: str, name: str, fields: tuple[str, ...] = (), least: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(id, entity, n): each key with its entity, named by its least key, and how many keys that has.

    Records that are alike in all are compared as one and counted as the pairs that they are; they are one entity if their pattern is probable
    enough or any of them has a link. Keys are unique; rows without one are left out; a record without words or values is an entity of its own.
    """
    n = len(fields)
    cols = ["tokens", *(f"f{i}" for i in range(n))]
    all_ = stash(records(rows, key, name, tuple(fields)), "records")
    reps = stash(all_.groupBy(*cols).agg(F.min("id").alias("id"), F.count("*").alias("copies")), "reps")
    pairs = blocks(reps, n, block)
    told = pairs.join(reps.select(F.col("id").alias("a"), F.struct(*cols).alias("x")), "a").join(reps.select(F.col("id").alias("b"), F.struct(*cols).alias("y")), "b")
    names = [f"g{i}" for i in range(n + 1)]
    told = stash(told.select("a", "b", *_agreement(n), F.coalesce(_edits(), F.lit(FAR)).alias("far")), "told")
    copied = reps.where("copies > 1").select(F.col("id"), F.struct(*cols).alias("x"), F.struct(*cols).alias("y"), (F.col("copies") * (F.col("copies") - 1) / 2).alias("n"))
    copied = stash(copied.select("id", "n", *_agreement(n)), "copied")
    seen = told.groupBy(*names).agg(F.count("*").cast("double").alias("n")).unionByName(copied.groupBy(*names).agg(F.sum("n").alias("n"))).groupBy(*names).agg(F.sum("n").alias("n")).collect()  # at most 5 * 3 ** n rows
    good = []
    if seen:
        patterns = np.array([[r[c] for c in names] for r in seen])
        counts, records_ = np.array([r["n"] for r in seen]), all_.count()
        met = np.bincount(patterns[patterns[:, 0] >= 0, 0], counts[patterns[:, 0] >= 0], 4)
        hits, looked = levels_by_chance(reps, n)
        total = max(records_ * (records_ - 1) / 2, counts.sum())
        # Levels that the sample hardly has are those of names nearly alike, which meet in blocks.
        levels = np.where((hits >= HITS) & (looked > 0), np.maximum(met, hits / max(looked, 1) * total), met)
        levels[0] = max(total - levels[1:].sum(), 0)
        p = fit(patterns, counts, chances(all_, n), levels, total)
        good = [tuple(int(v) for v in g) for g, q in zip(patterns, p, strict=True) if q >= least and (g >= 0).any()]
    probable = F.broadcast(rows.sparkSession.createDataFrame(good, ", ".join(f"{c} int" for c in names)))
    links = settled(told.join(probable, names, "left_semi").select("a", "b", "far"), reps, n)
    roots = components(links)
    alike = copied.join(probable, names, "left_semi").select(F.col("id").alias("_rep"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    of = all_.alias("l").join(reps.alias("r"), condition).select(F.col("l.id").alias("id"), F.col("r.id").alias("_rep"))
    of = of.join(roots.withColumnRenamed("id", "_rep"), "_rep", "left").join(alike.withColumn("_alike", F.lit(True)), "_rep", "left")
    out = stash(of.select("id", F.coalesce("root", F.when(F.col("_alike"), F.col("_rep")), "id").alias("entity")), "entities")
    unstash(all_, reps, pairs, told, links, copied)
    return out.join(out.groupBy("entity").agg(F.count("*").alias("n")), "entity").select("id", "entity", "n")
