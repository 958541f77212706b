"""Files of a stored index that a search doesn't read, and the signature of a table's files."""

import os
import random

from pyspark.sql import functions as F

from palimpsest.functions.normalise import for_match
from palimpsest.operators import lexical
from palimpsest.plans import boolean
from palimpsest.tables import signature, stored

WORDS = [["amor", "casa", "dia"], ["energia", "livro", "casa"], ["zebra", "quartzo", "dia"], ["ab", "xy", "ção"]]


def rows(rng):
    return [(i, part, "|".join(" ".join(rng.choice(WORDS[part]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4)))) for part in range(4) for i in range(part * 50, part * 50 + 50)]


def written(spark, tmp_path):
    df = spark.createDataFrame(rows(random.Random(1)), "id long, part int, text string")
    made = lexical.indexed(df, F.array("text"))
    for part in range(4):
        made.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/index")
    return spark.read.parquet(f"{tmp_path}/index")


def test_files_without_the_literals_are_not_read(spark, tmp_path):
    index = written(spark, tmp_path)
    signed = stored(lexical.signatures(index))
    assert signed.count() == 4 and all(len(r.bits) == 4096 for r in signed.collect())
    for query, files in (("energia", 1), ("casa", 2), ("energia | quartzo", 2), ("casa energia", 1), ("!casa", 4), ("energia zebra", 0), ('"livro casa"', 1), ("quar*zo", 1), ("(casa", 2), ("ab", 4), ("cao", 1)):
        assert len(lexical.files_for(signed, query)) == files, query
        read = lexical.within(index, signed, query)
        assert len(read.inputFiles()) == files
        assert sorted(r.id for r in lexical.search(read, query).collect()) == sorted(r.id for r in lexical.search(index, query).collect())


def test_index_in_folders_of_books(spark, tmp_path):
    df = spark.createDataFrame(rows(random.Random(2)), "id long, part int, text string")
    lexical.indexed(df, F.array("text")).coalesce(1).write.partitionBy("part").parquet(f"{tmp_path}/books")
    index = spark.read.parquet(f"{tmp_path}/books")
    read = lexical.within(index, lexical.signatures(index), "casa")
    assert len(read.inputFiles()) == 2 and {r.part for r in read.select("part").distinct().collect()} == {0, 1} and read.columns == index.columns


def test_no_match_is_in_a_file_left_out(spark, tmp_path):
    """Random queries: what row_matches() finds, possible() allows."""
    index = written(spark, tmp_path)
    rng, parts = random.Random(4), [w for ws in WORDS for w in ws] + ["&", "|", "!", "(", ")", '"', "am*r", "z*", "*", "energia livro", "d"]
    queries = []
    while len(queries) < 40:
        q = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        if boolean.match_text(q):
            queries.append(q)
    hit = index.select("part", *(boolean.row_matches(q, F.col("hay"), F.col("segs")).alias(f"q{i}") for i, q in enumerate(queries))).groupBy("part").agg(*(F.bool_or(f"q{i}").alias(f"q{i}") for i in range(len(queries))))
    names = {r.path: r.part for r in index.select(F.col("_metadata.file_path").alias("path"), "part").distinct().collect()}
    can = lexical.signatures(index).select("path", *(boolean.possible(q, lexical._holds).alias(f"q{i}") for i, q in enumerate(queries))).collect()
    allowed = {names[r.path]: r for r in can}
    for r in hit.collect():
        assert all(allowed[r.part][f"q{i}"] for i in range(len(queries)) if r[f"q{i}"])


def test_signature_follows_the_files(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/t")
    first = signature(spark.read.parquet(f"{tmp_path}/t"))
    assert signature(spark.read.parquet(f"{tmp_path}/t").where("id = 1")) == first
    spark.range(3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    second = signature(spark.read.parquet(f"{tmp_path}/t"))
    name = next(f for f in os.listdir(f"{tmp_path}/t") if f.endswith(".parquet"))
    os.utime(f"{tmp_path}/t/{name}", (1, 1))
    assert len({first, second, signature(spark.read.parquet(f"{tmp_path}/t"))}) == 3
    assert signature(spark.read.parquet(f"{tmp_path}/t/{name}")) not in (first, second)


def test_signatures_are_made_without_a_row_for_each_run(spark, tmp_path):
    plan = lexical.signatures(written(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_whole_text_is_that_of_its_segments(spark):
    cells = ["a  b", "x | - y |​| z", " ́ |́ c", " d  e\t|f\n\ng", "|", "​", "Σ αΣ|Σ", "!|?", "p | !? |q", "\x1c h\x1d\x1e"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id long, text string")
    made = lexical.indexed(df, F.array("text", F.lit("-"), F.lit("́")))
    whole = F.array_join(lexical.segments(F.array("text", F.lit("-"), F.lit("́"))), " ")
    for r in made.select("id", "hay", "segs", for_match(whole).alias("asked"), F.transform(lexical.segments(F.array("text", F.lit("-"), F.lit("́"))), for_match).alias("parts")).collect():
        assert (r.hay, r.segs) == (r.asked, r.parts), r
