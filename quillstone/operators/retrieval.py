"""Hybrid retrieval: entity recognition, BM25, vectors, rank fusion, expansion and citations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import terms_of, tokens
from quillstone.operators.graph import expand, small
from quillstone.operators.names import mentions  # noqa: F401 - a part of retrieval
from quillstone.sources.vault import lines as lines_of

K1, B, FUSION = 1.2, 0.75, 60
DIMENSIONS = 256
#: Places that a term's postings go to in a stored index.
SPREAD = 64


def recognise(question: str, aliases: DataFrame) -> DataFrame:
    """(id) of pages that an alias of any length in the question names, as a run of whole words; aliases: id, alias."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in question.lower()).split() if w]
    name = F.trim(F.regexp_replace(F.lower("alias"), "[^\\p{L}\\p{N}]+", " "))
    named = F.contains(F.lit(f" {' '.join(words)} "), F.concat(F.lit(" "), name, F.lit(" ")))
    return aliases.where((name != "") & named).select("id").distinct()


def aliases_of(pages: DataFrame) -> DataFrame:
    """(id, alias): each page's slug in words and its aliases."""
    names = F.concat(F.array(F.regexp_replace("slug", "-", " ")), F.coalesce("aliases", F.array().cast("array<string>")))
    return pages.select(F.col("slug").alias("id"), F.explode(names).alias("alias"))


def rerank(hits: DataFrame, near: DataFrame, boost: float = 2.0) -> DataFrame:
    """(id, score) of a shortlist with the scores of `near` (id), say neighbours of the question's entities, multiplied."""
    near = near.select("id", F.lit(boost).alias("_boost")).distinct()
    return hits.join(near, "id", "left").select("id", (F.col("score") * F.coalesce("_boost", F.lit(1.0))).alias("score"))


def bm25(docs: DataFrame, terms: list[str], id_: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of documents with any term: ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg)).

    Each document's term counts come from its own row by array functions, so nothing is exploded or
    shuffled; one row of corpus figures is worked out first and goes into the plan as constants.
    """
    words = tokens(text)
    rows = docs.select(F.col(id_).alias("id"), words.alias("w"))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    rows = rows.select("id", F.size("w").alias("dl"), *(count(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms)))).first()
    if not stats["avgdl"]:
        return rows.where("false").select("id", F.lit(0.0).alias("score"))

    def part(i: int):
        df, tf = stats[f"df{i}"], F.col(f"tf{i}")
        idf = math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(stats["avgdl"])))).otherwise(0.0)

    return rows.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).select("id", sum(part(i) for i in range(len(terms))).alias("score"))


def counted(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, dl, terms, tfs) of rows with words w (none if null): each one's terms with their counts, from its own row."""

    def run(parts):
        import numpy as np
        import pyarrow as pa

        for whole in parts:
            for begin in range(0, whole.num_rows, 2048):
                part = whole.slice(begin, 2048)
                sizes = part.column("w").value_lengths().to_numpy()
                coded = part.column("w").flatten().dictionary_encode()
                n = max(len(coded.dictionary), 1)
                key, tfs = np.unique(np.repeat(np.arange(len(sizes)) * n, sizes) + coded.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * n).astype(np.int32))
                terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key % n)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(sizes.astype(np.int64)), terms, pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))], [*keep, "dl", "terms", "tfs"])

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(*keep, F.coalesce("w", F.array().cast("array<string>")).alias("w")).mapInArrow(run, f"{kinds}dl long, terms array<string>, tfs array<int>")


def postings(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, id, tf, dl) of every document, by term: a stored index. Ids are unique.

    A document without terms is one row of the null term, so that the corpus figures count it. Terms are counted within their document's
    own row, so only postings are shuffled, once and not ahead of it to find ranges. A term goes to SPREAD places by its documents' ids, so
    that one that every document has lies in many files; files are sorted by term, so a question's terms prune the pages of the rest.
    """
    own = counted(docs.select(F.col(id_).alias("id"), tokens(text).alias("w")), "id")
    each = own.select("id", "dl", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("p"))
    rows = each.select(F.col("p.terms").alias("term"), "id", F.coalesce("p.tfs", F.lit(0)).cast("long").alias("tf"), "dl")
    return rows.repartition("term", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("term", "id")


def lengths(index: DataFrame) -> DataFrame:
    """(n, total) documents and terms of a stored index, in one row.

    A document's shares tf / dl add up to 1, so documents are counted by a sum and no ids are shuffled.
    """
    share = F.when(F.col("term").isNull(), 1.0).otherwise(F.col("tf") / F.col("dl"))
    return index.agg(F.coalesce(F.round(F.sum(share)), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))


def bm25_stored(index: DataFrame, terms: list[str], figures: tuple[int, int] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """`bm25` from a stored index: only the rows of the question's terms are read. figures: those of `lengths`, if known."""
    n, total = figures or tuple(lengths(index).first())
    own = index.where(F.col("term").isin(*terms))
    df = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.count("*").alias("df")).collect()}  # one a term of the question
    if not df:
        return own.select("id", F.lit(0.0).alias("score")).where("false")
    idf = F.element_at(F.create_map(*(F.lit(x) for t, d in sorted(df.items()) for x in (t, math.log(1 + (n - d + 0.5) / (d + 0.5))))), F.col("term"))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(total / n)))
    return own.groupBy("id").agg(F.sum(part).alias("score"))


def hashed_vectors(index: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, vector) of a stored index's documents: each term adds 1 + ln(tf) to or takes it from the dimension that its hash picks.

    What stands in for a trained embedding where a caller brings none; a question's vector is made the same way.
    """
    h = F.xxhash64("term")
    rows = index.where("term is not null").select("id", F.pmod(h, F.lit(dimensions)).cast("int").alias("d"), (F.when(F.xxhash64(F.lit(1), "term") % 2 == 0, 1.0).otherwise(-1.0) * (1 + F.log(F.col("tf")))).alias("v"))
    sums = rows.groupBy("id", "d").agg(F.sum("v").alias("v")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("m"))  # `dimensions` entries at most
    return sums.select("id", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.element_at("m", d), F.lit(0.0))).alias("vector"))


def vectors_of_rows(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """`hashed_vectors` of documents (id, terms, tfs), each from its own row; those without terms are left out."""
    at = F.transform("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int"))
    add = F.zip_with("terms", "tfs", lambda t, n: F.when(F.xxhash64(F.lit(1), t) % 2 == 0, 1.0).otherwise(-1.0) * (1 + F.log(n)))

    def run(parts):
        import numpy as np
        import pyarrow as pa

        for whole in parts:
            for begin in range(0, whole.num_rows, 1024):
                part = whole.slice(begin, 1024)
                n, sizes = part.num_rows, part.column("at").value_lengths().to_numpy()
                place = np.repeat(np.arange(n) * dimensions, sizes) + part.column("at").flatten().to_numpy()
                sums = np.bincount(place, part.column("add").flatten().to_numpy(), n * dimensions)
                vector = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dimensions), pa.array(sums))
                yield pa.RecordBatch.from_arrays([part.column("id"), vector], ["id", "vector"])

    id_ = rows.schema["id"].dataType.simpleString()
    return rows.where(F.size("terms") > 0).select("id", at.alias("at"), add.alias("add")).mapInArrow(run, f"id {id_}, vector array<double>")


def cosine(vectors: DataFrame, query: list[float], id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score): cosine with the query; 0-length vectors have no score and are left out."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = float(sum(float(x) ** 2 for x in query)) ** 0.5
    rows = vectors.select(F.col(id_).alias("id"), dot(v, q).alias("d"), F.sqrt(dot(v, v)).alias("n"))
    return rows.where(F.col("n") > 0).select("id", (F.col("d") / (F.col("n") * norm)).alias("score")) if norm else rows.where("false").select("id", F.col("d").alias("score"))


def top(scored: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k best by score, ties by id: TakeOrderedAndProject, k rows per task."""
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def fuse(first: DataFrame, second: DataFrame, k: int, constant: int = FUSION) -> DataFrame:
    """(id, rrf) of two short ranked lists (id, score): sum of 1 / (constant + rank)."""
    from pyspark.sql import Window

    ranked = lambda df: df.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("r"))  # noqa: E731 - lists are cut to k before
    both = ranked(first).unionAll(ranked(second)).groupBy("id").agg(F.sum(1.0 / (constant + F.col("r"))).alias("rrf"))
    return both.orderBy(F.desc("rrf"), "id").limit(k)


def cite(hits: DataFrame, lines: DataFrame, terms: list[str]) -> DataFrame:
    """(path, line, text) of the hits' lines that have a term; hits: path, lines: path, line, text, or items (path, content), of which only the hits' are cut into lines."""
    words = tokens("text")
    if "content" in lines.columns:
        return lines_of(lines.join(small(hits.select("path").distinct()), "path", "left_semi")).where(F.arrays_overlap(words, F.array(*(F.lit(t) for t in terms))))
    return lines.join(small(hits.select("path").distinct()), "path").where(F.arrays_overlap(words, F.array(*(F.lit(t) for t in terms))))


def query(question: str, pages: DataFrame, edges: DataFrame, lines: DataFrame, k: int = 10, edge_names: list[str] | None = None, index: DataFrame | None = None, vectors: DataFrame | None = None, asked: list[float] | None = None, found: Callable[[list[str], int], DataFrame] | None = None) -> DataFrame:
    """Answer as passages: (path, line, text, score) from the k best pages and the raw files that they cite.

    Keyword and vector ranks, a shortlist of each, are fused; seeds are pages that the question names, widened by one hop, and a
    candidate's score is doubled if it was reached that way. index, vectors: the stored ones of the pages (id is the
    slug), worked out here if missing; asked: the question's vector, by default the hashed one; found: the k best of some terms as
    (id, score), by an index that stops early for instance, in the place of scoring all postings.
    """
    spark = pages.sparkSession
    seeds = recognise(question, aliases_of(pages))
    near = seeds.unionAll(expand(seeds, edges, edge_names).select("id"))
    terms = [t for t in terms_of(question) if len(t) > 2]
    if not terms:
        return lines.where("false").withColumn("score", F.lit(0.0))
    if index is None and (found is None or vectors is None):
        index = postings(searched(pages), "slug")
    if vectors is None:
        vectors = hashed_vectors(index)
    if asked is None:
        own = hashed_vectors(postings(spark.createDataFrame([("q", " ".join(terms))], "doc_id string, text string"))).first()
        asked = list(own["vector"])
    short = max(5 * k, 50)
    keyed = found(terms, short) if found is not None else top(bm25_stored(index, terms), short)
    fused = fuse(keyed, top(cosine(vectors, asked, "id", "vector").where("score > 0"), short), 2 * short)
    best = top(rerank(fused.withColumnRenamed("rrf", "score"), near), k)
    cited = pages.join(best.select(F.col("id").alias("slug"), "score"), "slug").select(F.explode(F.concat(F.array("path"), F.coalesce("sources", F.array().cast("array<string>")))).alias("path"), "score")
    cited = cited.groupBy("path").agg(F.max("score").alias("score"))
    return cite(cited, lines, terms).join(cited, "path").select("path", "line", "text", "score").orderBy(F.desc("score"), "path", "line")


def searched(pages: DataFrame) -> DataFrame:
    """(slug, text): what search looks at in a page."""
    return pages.select("slug", F.concat_ws(" ", F.regexp_replace("slug", "-", " "), "body").alias("text"))
