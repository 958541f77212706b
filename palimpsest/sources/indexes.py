"""Indexes kept as tables: the normalised corpus, entries with postings, and vector indexes with their manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import chunks as chunking
from palimpsest.operators import citations, lexical, semantic
from palimpsest.operators.places import placed
from palimpsest.sources import versions
from palimpsest.tables import stored

VERSION = 1


def write_corpus(corpus: DataFrame, cells: Column, book: str, path: str) -> None:
    """Writes what searches read, by book, so that a search of one book reads that one only."""
    lexical.indexed(corpus, cells).write.mode("overwrite").partitionBy(book).parquet(path)


def write_citations(entries: DataFrame, signature: str, path: str) -> None:
    """Writes entries and postings under a signature of their source, as one version."""
    spark = entries.sparkSession
    with versions.writing(spark, path) as folder:
        entries.write.parquet(f"{folder}/entries")
        citations.postings(spark.read.parquet(f"{folder}/entries")).write.parquet(f"{folder}/postings")
        spark.createDataFrame([(VERSION, signature)], "version int, signature string").write.parquet(f"{folder}/meta")


def read_citations(spark: SparkSession, signature: str, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(entries, postings), or None if there are none of this version and signature. Both are of one writing."""
    folder = versions.current(spark, path)
    meta = spark.read.parquet(f"{folder}/meta").first() if folder else None
    if meta is None or (meta.version, meta.signature) != (VERSION, signature):
        return None
    return spark.read.parquet(f"{folder}/entries"), spark.read.parquet(f"{folder}/postings")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a rebuilt index with their vectors, both of its current version; FileNotFoundError without one."""
    folder = versions.current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no index in {path}")
    return joined(spark.read.parquet(f"{folder}/metadata"), spark.read.parquet(f"{folder}/embeddings"))


def summary(entries: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: entries, books and distinct tokens."""
    return entries.agg(F.count("*").alias("entries"), F.count_distinct("file").alias("books")).crossJoin(postings.agg(F.count_distinct("token").alias("tokens")))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Vector indexes below a folder by their manifest.json files, of several versions the current one: id, label, source_file, rows, model, dimensions, dtype, recommended."""
    schema = "id string, index_label string, source_file string, indexed_rows long, model string, dimensions int, embedding_dtype string, recommended_min_score string"
    files = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", "true").json(path)
    # of indexes written here, the current version counts; others have their manifest in their own folder
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/manifest\.json$", "")
    held = files.withColumn("_folder", folder)
    found = held.join(versions.current_folders(spark, path).select(F.col("folder").alias("_folder"), F.lit(True).alias("_now")), "_folder", "left").where(~F.col("_folder").rlike(r"/version-[0-9a-f]{32}$") | F.col("_now"))
    id_ = F.lower(F.trim("id"))
    return found.where("id is not null").select(id_.alias("id"), F.coalesce("index_label", "id").alias("label"), "source_file", F.col("indexed_rows").alias("rows"), "model", "dimensions", F.col("embedding_dtype").alias("dtype"), semantic.recommended(F.col("recommended_min_score")).alias("recommended")).orderBy("id")


def joined(metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows with their vectors, by (index_id, pos). ValueError if an index has more of one than of the other."""
    counts = metadata.groupBy("index_id").agg(F.count("*").alias("m")).join(vectors.groupBy("index_id").agg(F.count("*").alias("v")), "index_id", "full")
    wrong = counts.where("not (m <=> v)").select("index_id").take(5)
    if wrong:
        raise ValueError(f"rows and vectors differ: {', '.join(str(r.index_id) for r in wrong)}")
    return metadata.join(vectors, ["index_id", "pos"])


def recalibrated(vectors: DataFrame) -> DataFrame:
    """Statistics and recommended threshold of each index, from what is stored."""
    return semantic.calibration(semantic.sampled_pairs(vectors))


def source_rows(sheet: DataFrame, text: str = "text", metadata: list[str] = ()) -> DataFrame:
    """(row, text, text_plain, metadata) of the rows of workbooks (row, data) that have a text; blank metadata is left out.

    Column names are compared in lower case; the metadata's keys keep their spelling.
    """
    body = F.trim(F.coalesce(F.col("data")[text.strip().lower()], F.lit("")))
    entries_ = F.array(*(F.struct(F.lit(m).alias("key"), F.trim(F.coalesce(F.col("data")[m.lower()], F.lit(""))).alias("value")) for m in metadata if m.strip()))
    said = F.map_from_entries(F.filter(entries_, lambda e: e["value"] != "")) if metadata else F.create_map().cast("map<string,string>")
    return sheet.select("row", body.alias("text"), body.alias("text_plain"), said.alias("metadata")).where("text != ''")


def rows_to_rebuild(sheet: DataFrame | None, snapshot: DataFrame, source_file: str, text: str = "text", metadata: list[str] = (), require: bool = False) -> tuple[DataFrame, str, str | None]:
    """(rows, basis, warning): those of the source file, else those that the index keeps; FileNotFoundError if it must be the file."""
    if sheet is not None and sheet.take(1):
        return source_rows(sheet, text, metadata), "source_file", None
    if source_file and require:
        raise FileNotFoundError(f"no such source file: {source_file}")
    warning = f"the source file is missing, the rows of the kept metadata.json are used ({source_file})" if source_file else None
    return snapshot, "metadata_snapshot", warning


def rebuild(rows: DataFrame, index_id: str, label: str, embed, path: str, model: str, basis: str, warning: str | None, sizes: tuple[int, int, int] = (280, 420, 110)) -> DataFrame:
    """Writes a version of an index, rows, vectors and manifest, and returns one row that says what was done.

    Until all is written, readers have the version before; a writing that ends early leaves that one in place.

    embed(chunks) gives chunks (with embedding_text) an `embedding` column: any provider that works on a DataFrame, in
    batches or from a table. Vectors are brought to length 1 and calibrated as they are stored.
    """
    spark = rows.sparkSession
    chunks = chunking.rechunked(rows, label, *sizes)
    # an index is numbered from 0 on, in the order of its source
    numbered = placed(chunks, ["row", F.coalesce(F.col("metadata")["chunk_index"].cast("int"), F.lit(0))], "pos")
    made = embed(numbered).select(F.lit(index_id).alias("index_id"), "pos", "row", "text", "text_plain", "metadata", F.transform(semantic.unit(F.col("embedding")), lambda x: x.cast("float")).alias("embedding"))
    with versions.writing(spark, path) as folder:
        made = stored(made, "embedded")  # the provider is asked once
        made.drop("embedding").write.parquet(f"{folder}/metadata")
        made.select("index_id", "pos", "embedding").write.parquet(f"{folder}/embeddings")
        vectors = spark.read.parquet(f"{folder}/embeddings")
        counts = vectors.groupBy("index_id").agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dimensions"))
        stats = semantic.calibration(semantic.sampled_pairs(vectors))
        payload = semantic.calibration_payload(stats, counts.select("index_id", "rows"), F.current_timestamp())
        recommended = stats.select("index_id", F.col("recommended").alias("recommended_min_score"))
        chunked_ = F.struct(F.lit(1).alias("version"), F.lit("structural_sentence_rechunk").alias("strategy"), *(F.lit(n).alias(c) for c, n in zip(("targetChars", "maxChars", "minChars"), sizes, strict=True)), F.lit(rows.count()).alias("rebuiltFromRows"))
        manifest = counts.join(recommended, "index_id", "left").join(payload, "index_id").select(
            F.col("index_id").alias("id"), F.lit(label).alias("index_label"), F.lit(model).alias("model"), F.lit("float32").alias("embedding_dtype"), "dimensions", F.col("rows").alias("indexed_rows"), F.lit("l2").alias("normalization"),
            F.coalesce("recommended_min_score", F.lit(semantic.FLOOR)).alias("recommended_min_score"), "score_calibration", F.lit(basis).alias("rebuild_basis"), chunked_.alias("chunking"), F.current_timestamp().alias("generated_at"),
        )
        manifest.write.parquet(f"{folder}/manifest")
        written = spark.read.parquet(f"{folder}/manifest")
        for r in written.select(F.to_json(F.struct("*")).alias("json")).take(1):  # one row an index
            versions.write_text(spark, f"{folder}/manifest.json", r.json)
    return written.select(F.col("id").alias("index_id"), F.col("chunking.rebuiltFromRows").alias("rows_before"), F.col("indexed_rows").alias("rows_after"), "model", "recommended_min_score", "rebuild_basis", F.lit(warning).cast("string").alias("warning"))
