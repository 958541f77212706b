"""Search by vectors: threshold, filter of rows that the boolean search finds anyway, reranking, several indexes at once.

An index is rows (index_id, pos, row, text, metadata, embedding); embeddings are of length 1, or made so by unit().
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.normalise import citation_text, for_semantic, match_text
from palimpsest.operators.lexical import limit_of
from palimpsest.plans import boolean

#: Weights of the reranked score and of the alignment of query and text.
SEMANTIC, ALIGNMENT = 0.82, 0.18
COVERAGE, ORDER, PHRASE, META_COVERAGE, META_PHRASE = 0.44, 0.18, 0.24, 0.10, 0.04
POOL = 40
FLOOR, MARGIN = 0.25, 0.02
CALIBRATION_PAIRS, CALIBRATION_SEED = 5000, 0
#: Words that the reranking skips.
RERANK_STOPWORDS = ["a", "ao", "aos", "as", "com", "da", "das", "de", "do", "dos", "e", "em", "na", "nas", "no", "nos", "o", "os", "para", "por", "sem", "um", "uma", "uns", "umas"]
#: Words that are no key terms of a query.
CONTEXT_STOPWORDS = ["a", "ao", "aos", "as", "com", "como", "da", "das", "de", "do", "dos", "e", "em", "na", "nas", "no", "nos", "o", "os", "ou", "para", "por", "qual", "quais", "que", "sem", "sobre", "um", "uma"]


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, summed from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; one of length 0 stays."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(size == 0, F.lit(1.0)).otherwise(size))


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def weighted_query(queries: DataFrame) -> DataFrame:
    """One row (embedding): the weighted mean of the unit vectors in (embedding, weight), at length 1."""
    parts = queries.select("weight", F.posexplode(unit(F.col("embedding"))).alias("at", "x"))
    mean = parts.groupBy("at").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
    return mean.agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select(unit(F.transform("v", lambda p: p["x"])).alias("embedding"))


def rerank_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.findall(r"\w+", match_text(query)) if len(t) >= 2 and t not in RERANK_STOPWORDS))


def term_coverage(terms: list[str], text: Column) -> Column:
    """Part of the terms that are whole words of the text."""
    if not terms:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.split(text, " "), F.array(*map(F.lit, terms)))) / F.lit(float(len(terms)))


def ordered_terms(terms: list[str], text: Column) -> Column:
    """Part of the terms found one after the other as substrings; one not found is passed over."""
    if not terms:
        return F.lit(0.0)
    start = F.struct(F.lit(0).alias("hits"), F.lit(1).alias("at"))

    def step(s: Column, t: Column) -> Column:
        at = F.call_function("locate", t, text, s["at"])
        return F.when(at > 0, F.struct((s["hits"] + 1).alias("hits"), (at + F.length(t)).alias("at"))).otherwise(s)

    return F.aggregate(F.array(*map(F.lit, terms)), start, step, lambda s: s["hits"] / F.lit(float(len(terms))))


def phrase_hit(query: str, text: Column) -> Column:
    q = match_text(query)
    return F.when(F.contains(text, F.lit(q)), 1.0).otherwise(0.0) if q else F.lit(0.0)


MOST_VALUES = 16


def _joined_values(values: Column) -> Column:
    """The first MOST_VALUES that have a normalised text, joined."""
    return F.array_join(F.slice(F.filter(F.transform(values, for_semantic), lambda v: F.coalesce(v, F.lit("")) != ""), 1, MOST_VALUES), " ")


def metadata_text(metadata: Column) -> Column:
    """The first MOST_VALUES values of a map that have a text, normalised."""
    return _joined_values(F.map_values(metadata))


def nested_metadata_text(json: Column) -> Column:
    """The same of an object of JSON: its values and those of the objects and arrays among them, two levels deep, in order.

    Deeper ones and nulls don't count. A text that is no object has none.
    """

    def kind(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))

    def deep(v: Column) -> Column:
        return F.startswith(kind(v), F.lit("OBJECT")) | F.startswith(kind(v), F.lit("ARRAY"))

    def scalars(vs: Column) -> Column:
        plain = F.filter(vs, lambda v: ~deep(v) & (kind(v) != "VOID"))
        return F.transform(plain, lambda v: F.try_variant_get(v, "$", "string"))

    def of(entry: Column) -> Column:
        v, raw = entry["v"], entry["raw"]
        within = F.when(F.startswith(kind(v), F.lit("OBJECT")), F.map_values(F.from_json(raw, "map<string,variant>"))).when(F.startswith(kind(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>"))
        return scalars(F.when(deep(v), within).otherwise(F.array(v)))

    # the text of a nested object keeps the order of its keys, which its parsed form does not
    entries = F.arrays_zip(F.map_values(F.from_json(json, "map<string,variant>")).alias("v"), F.map_values(F.from_json(json, "map<string,string>")).alias("raw"))
    named = F.transform(entries, lambda e: F.struct(e["v"].alias("v"), e["raw"].alias("raw")))
    return F.coalesce(_joined_values(F.flatten(F.transform(named, of))), F.lit(""))


def normalised(index: DataFrame, text: Column, metadata: Column) -> DataFrame:
    """index with _text and _meta, what alignment() compares.

    They are fields of an array's element, so that each text is normalised once, not again for each term of a query.
    """
    made = F.struct(for_semantic(text).alias("text"), metadata_text(metadata).alias("meta"))
    return index.withColumn("_made", F.explode(F.array(made))).withColumns({"_text": F.col("_made.text"), "_meta": F.col("_made.meta")}).drop("_made")


def alignment(query: str, text: Column, meta: Column) -> Column:
    """How far the words of the query, their order and the phrase stand in the normalised text and metadata."""
    terms = rerank_terms(query)
    total = COVERAGE * term_coverage(terms, text) + ORDER * ordered_terms(terms, text) + PHRASE * phrase_hit(query, text)
    return F.least(F.lit(1.0), total + META_COVERAGE * term_coverage(terms, meta) + META_PHRASE * phrase_hit(query, meta))


def recommended(score: Column) -> Column:
    """A stored recommendation within 0 and 1; FLOOR where it is missing or no number."""
    x = score.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), FLOOR).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def eligible(index: DataFrame, query_vector: Column, query: str = "", minimum: float | None = None, exclude: bool = False, thresholds: DataFrame | None = None) -> DataFrame:
    """Rows with a finite semantic score at or above the threshold, and `lexical`: whether the boolean search has them.

    The threshold is the caller's, else that of thresholds (index_id, recommended), else FLOOR; one of 0 or less is none.
    """
    scored = index.withColumn("semantic", dot(F.col("embedding"), query_vector))
    if minimum is not None:
        scored = scored.withColumn("threshold", F.lit(max(0.0, float(minimum))))
    elif thresholds is not None:
        scored = scored.join(thresholds, "index_id", "left").withColumn("threshold", F.coalesce("recommended", F.lit(FLOOR))).drop("recommended")
    else:
        scored = scored.withColumn("threshold", F.lit(FLOOR))
    finite = ~F.isnan("semantic") & (F.abs("semantic") != float("inf"))
    scored = scored.where(finite & ((F.col("threshold") <= 0) | (F.col("semantic") >= F.col("threshold"))))
    if not exclude:
        return scored.withColumn("lexical", F.lit(False))
    text = for_semantic(F.col("text"))
    found = (text != "") & boolean.prefilter(query, text) & boolean.predicate(query, text)
    return scored.withColumn("lexical", F.coalesce(found, F.lit(False)))


def counts(scored: DataFrame) -> DataFrame:
    """index_id, total (rows to show), filtered (rows that the boolean search has)."""
    return scored.groupBy("index_id").agg(F.count_if(~F.col("lexical")).alias("total"), F.count_if("lexical").alias("filtered"))


def pool_size(k: int, total: Column) -> Column:
    """How many candidates are reranked for k results."""
    top = F.least(F.lit(max(1, k)), total)
    return F.least(total, F.greatest(top, F.least(F.lit(POOL), 4 * top)))


def reranked(scored: DataFrame, query: str, k: int) -> DataFrame:
    """The best k rows of each index: a pool by semantic score, then by the score with alignment. rank starts at 1.

    Ties of the semantic score go by row, then place.
    """
    by = Window.partitionBy("index_id")
    first = by.orderBy(F.desc("semantic"), "row", "pos")
    most = max(k, POOL, 4)
    # a pool has `most` rows at most; the limit by rank comes before the texts are touched
    pool = scored.where("not lexical").withColumn("_at", F.row_number().over(first))
    sizes = scored.groupBy("index_id").agg(F.count_if(~F.col("lexical")).alias("total"))
    pool = pool.where(F.col("_at") <= most).join(F.broadcast(sizes), "index_id").where(F.col("_at") <= pool_size(k, F.col("total")))
    text, meta = for_semantic(F.col("text")), metadata_text(F.col("metadata"))
    pool = pool.withColumn("alignment", alignment(query, text, meta))
    pool = pool.withColumn("score", F.least(F.lit(1.0), SEMANTIC * F.col("semantic") + ALIGNMENT * F.col("alignment")))
    order = by.orderBy(F.desc("score"), F.desc("semantic"), "row", "pos")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k)).drop("_at")


def search(index: DataFrame, query_vector: Column, query: str, k: int = 10, minimum: float | None = None, exclude: bool = False, thresholds: DataFrame | None = None) -> DataFrame:
    """The best k rows of each index."""
    return reranked(eligible(index, query_vector, query, minimum, exclude, thresholds), query, limit_of(k, 10, 1, 50))


def overview(index: DataFrame, query_vector: Column, query: str, k: int = 50, minimum: float | None = None, exclude: bool = False, thresholds: DataFrame | None = None) -> DataFrame:
    """The best k rows over all indexes, with `total` of their index and `place`; equal scores go by index, then rank."""
    k = limit_of(k, 50, 1, 100)
    best = reranked(eligible(index, query_vector, query, minimum, exclude, thresholds), query, k)
    top = best.orderBy(F.desc("score"), F.lower("index_id"), "rank").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.lower("index_id"), "rank")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, id, similarity, place): the k likest of vectors (id, embedding) for each of queries (query_id, embedding).

    Both are dealt in blocks, a row each; every block of queries meets every block of vectors as one product, which
    leaves the best k of the block. Sums go from left to right in double, equal similarities by id.
    """
    def blocks(df: DataFrame, key: str) -> DataFrame:
        n = df.count()
        lot = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // block))))
        return df.groupBy(lot.alias("_lot")).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("i"), F.col("embedding").cast("array<double>").alias("v"))).alias("_rows")).drop("_lot")

    out = "array<struct<query_id:long,id:long,similarity:double>>"

    @F.pandas_udf(out)
    def best(left: pd.Series, right: pd.Series) -> pd.Series:
        made = []
        for a, q in zip(left, right, strict=True):
            ids, v = np.array([r["i"] for r in a]), np.array([r["v"] for r in a])
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            w = np.array([r["v"] for r in q])
            total = np.zeros((len(w), len(v)))
            for d in range(v.shape[1]):
                total += w[:, d][:, None] * v[:, d][None, :]
            top = np.argsort(-total, axis=1, kind="stable")[:, :k]
            made.append([{"query_id": int(r["i"]), "id": int(ids[j]), "similarity": float(total[n, j])} for n, r in enumerate(q) for j in top[n]])
        return pd.Series(made)

    own, asked = blocks(vectors, "id"), blocks(queries, "query_id").withColumnRenamed("_rows", "_asked")
    found = own.crossJoin(asked).select(F.explode(best("_rows", "_asked")).alias("x")).select("x.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def overview_groups(shown: DataFrame, indexes: DataFrame) -> DataFrame:
    """One row for each index with shown rows: total, shown_count, top_score, place (best score first), matches in order.

    shown is an overview(), k rows at most. indexes (index_id, label) name them; one without a label has its id.
    """
    groups = shown.groupBy("index_id").agg(F.max("total").alias("total"), F.count("*").alias("shown_count"), F.max("score").alias("top_score"), F.min("place").alias("_first"), F.array_sort(F.collect_list(F.struct("place", "row", "score"))).alias("matches"))
    named = groups.join(F.broadcast(indexes.select("index_id", "label").dropDuplicates(["index_id"])) if indexes is not None else groups.select("index_id", F.lit(None).cast("string").alias("label")), "index_id", "left")
    place = F.row_number().over(Window.orderBy(F.desc("top_score"), "_first"))
    return named.select("index_id", F.coalesce(F.nullif("label", F.lit("")), "index_id").alias("label"), "total", "shown_count", "top_score", place.alias("place"), "matches")


def overview_totals(scored: DataFrame, indexes: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """One row: indexes, total and filtered rows of all indexes, shown or not, and the range of their recommended thresholds.

    scored is what is eligible(); indexes have index_id. An index without a recommendation has FLOOR.
    """
    sums = scored.agg(F.count_if(~F.col("lexical")).alias("total"), F.count_if("lexical").alias("filtered"))
    known = indexes.select("index_id").distinct()
    known = known.join(thresholds, "index_id", "left") if thresholds is not None else known.withColumn("recommended", F.lit(None).cast("double"))
    low, high = (f(F.coalesce("recommended", F.lit(FLOOR))) for f in (F.min, F.max))
    span = known.agg(F.count("*").alias("indexes"), F.coalesce(low, F.lit(FLOOR)).alias("lowest_recommended"), F.coalesce(high, F.lit(FLOOR)).alias("highest_recommended"))
    return span.crossJoin(F.broadcast(sums))  # two tables of one row


def key_terms(query: str, most: int = 8) -> list[str]:
    """Quoted phrases first, then words of three letters or more that are no stopwords."""
    quoted = [q.strip() for q in re.findall(r'"([^"]+)"', query)]
    words = [w for w in re.findall(r"[\w-]{3,}", query.lower()) if citation_text(w) not in CONTEXT_STOPWORDS]
    return list(dict.fromkeys(x for x in quoted + words if x))[:most]


#: Terms of the field and what they stand for, by word and by phrase.
ALIASES = {
    "recin": ["reciclagem intraconsciencial"],
    "recins": ["reciclagens intraconscienciais", "reciclagem intraconsciencial"],
    "recexis": ["reciclagem existencial"],
    "recinex": ["reciclagem intraconsciencial", "reciclagem existencial"],
    "invexis": ["inversao existencial"],
    "invexes": ["inversoes existenciais", "inversao existencial"],
    "tenepes": ["tarefa energetica pessoal"],
    "gescon": ["gestacao consciencial"],
    "gescons": ["gestacoes conscienciais", "gestacao consciencial"],
    "proexis": ["programacao existencial"],
    "proexes": ["programacoes existenciais", "programacao existencial"],
    "complexis": ["completismo existencial"],
    "duplismo": ["dupla evolutiva"],
    "duplistas": ["dupla evolutiva"],
    "holopensene": ["holopensene pessoal"],
    "holopensenes": ["holopensenes pessoais", "holopensene pessoal"],
    "ortopensata": ["ortopensata", "pensene ortopensenico"],
    "ortopensatas": ["ortopensatas", "pensenes ortopensenicos"],
}
PHRASES = {"curso intermissivo": ["intermissao", "periodo intermissivo"], "estado vibracional": ["ev", "vibracao energetica consciencial"], "dupla evolutiva": ["duplismo"]}
RELATED, ALONE, DISAMBIGUATED, MEANINGS = 0.84, 0.72, 0.90, 0.64


def _unlike(variants: list[tuple[str, float]], form) -> list[tuple[str, float]]:
    """Variants that are not blank, the first one of each form."""
    first: dict[str, tuple[str, float]] = {}
    for text, weight in variants:
        if key := form(text):
            first.setdefault(key, (text.strip(), weight))
    return list(first.values())


def query_variants(query: str, aliases: dict[str, list[str]] = ALIASES, phrases: dict[str, list[str]] = PHRASES, most: int = 4) -> list[tuple[str, float]]:
    """The query and variants with related terms, with weights; none of a blank query."""
    query = query.strip()
    form = citation_text(query)
    related = [x for t in re.findall(r"\w+", form) for x in aliases.get(t, [])] + [x for p, more in phrases.items() if p in form for x in more]
    related = [x for x, _ in _unlike([(x, 0.0) for x in related], citation_text)]
    out = [(query, 1.0)]
    if related:
        out += [(f"{query}. Termos relacionados: {', '.join(related[:4])}.", RELATED), (", ".join(related[:6]), ALONE)]
    return _unlike(out, citation_text)[: max(1, most)]


def contextual_variants(query: str, disambiguated: str = "", related: list[str] = (), definitions: list[tuple[str, str]] = (), most: int = 6) -> list[tuple[str, float]]:
    """query_variants and what a context adds: the query told apart, eight related terms, four terms with their meanings."""
    terms = [t for x in related if (t := (x or "").strip())]
    told = [f"{t}: {m}" for x, y in definitions if (t := (x or "").strip()) and (m := (y or "").strip())]
    more = [(disambiguated or "", DISAMBIGUATED), (", ".join(terms[:8]), ALONE), (" | ".join(told[:4]), MEANINGS)]
    return _unlike(query_variants(query) + more, match_text)[:most]


def calibration(pairs: DataFrame, by: str = "index_id") -> DataFrame:
    """Statistics of the column `similarity` for each index, and the threshold they recommend."""
    out = pairs.groupBy(by).agg(F.count("*").alias("pairs"), F.avg("similarity").alias("mean"), F.percentile("similarity", F.array(F.lit(0.95), F.lit(0.99), F.lit(0.999))).alias("p"), F.max("similarity").alias("highest"))
    return out.select(by, "pairs", "mean", F.col("p")[0].alias("p95"), F.col("p")[1].alias("p99"), F.col("p")[2].alias("p999"), "highest", recommend(F.col("p")[1]).alias("recommended"))


#: What an index of fewer than two vectors has none of: 0 in a manifest.
STATISTICS = ["meanSimilarity", "p95Similarity", "p99Similarity", "p999Similarity", "maxSimilarity"]


def calibration_payload(stats: DataFrame, rows: DataFrame, at: Column, by: str = "index_id") -> DataFrame:
    """(by, score_calibration): the statistics as a manifest keeps them; rows are (by, rows)."""
    fields = {
        "version": F.lit(1), "method": F.lit("random_pair_p99_plus_margin"), "margin": F.lit(MARGIN), "seed": F.lit(CALIBRATION_SEED), "samplePairs": F.col("pairs"), "rows": F.col("rows"), "meanSimilarity": F.col("mean"),
        "p95Similarity": F.col("p95"), "p99Similarity": F.col("p99"), "p999Similarity": F.col("p999"), "maxSimilarity": F.col("highest"), "calibratedAt": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }
    return rows.join(stats, by, "left").select(by, F.struct(*(F.coalesce(c, F.lit(0)).alias(n) if n in ("samplePairs", *STATISTICS) else c.alias(n) for n, c in fields.items())).alias("score_calibration"))


def recommend(p99: Column, margin: float = MARGIN) -> Column:
    """The 99th percentile and a margin, rounded up to hundredths, between FLOOR and 1."""
    return F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), F.ceil((p99 + F.lit(margin)) * 100) / 100))


def sampled_pairs(vectors: DataFrame, most: int = CALIBRATION_PAIRS, least: int = 500, seed: int = CALIBRATION_SEED) -> DataFrame:
    """(index_id, similarity) of random pairs of vectors (index_id, pos, embedding), pos from 0 on without gaps.

    An index of n vectors has min(max(least, 2 n), most) pairs, as its statistics need no more; one of fewer than two
    has none. Both ends of a pair are drawn from a digest of seed, index and the pair's number, the second one among the
    others; a pair of a vector with itself can't come up. What is joined is `most` pairs an index, never all vectors.
    """
    sizes = vectors.groupBy("index_id").agg(F.count("*").alias("n")).where("n > 1")
    count = F.least(F.greatest(F.lit(least), 2 * F.col("n")), F.lit(most))
    draws = sizes.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), count)))

    def drawn(which: int, among: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(which)), "index_id", F.col("k").cast("string")))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % among

    left = drawn(0, F.col("n"))
    draws = draws.select("index_id", "k", left.alias("l"), F.pmod(left + 1 + drawn(1, F.col("n") - 1), F.col("n")).alias("r"))
    a = vectors.select("index_id", F.col("pos").alias("l"), F.col("embedding").alias("x"))
    b = vectors.select("index_id", F.col("pos").alias("r"), F.col("embedding").alias("y"))
    return draws.join(a, ["index_id", "l"]).join(b, ["index_id", "r"]).select("index_id", dot(F.col("x"), F.col("y")).alias("similarity"))
