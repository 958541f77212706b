"""Bibliographic records out of the JSON of three services, one schema for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = ["titulo", "ano", "editora", "local", "paginas_totais", "revista", "tipo", "autores"]


def person(name: Column) -> Column:
    """The last word is the surname."""
    words = F.split(F.trim(name), r"\s+")
    return F.struct(F.element_at(words, -1).alias("sobrenome"), F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("nome"))


def _record(rows: DataFrame, key: str, **columns: Column) -> DataFrame:
    return rows.select(key, *(columns.get(c, F.lit(None).cast("string")).alias(c) for c in RECORD))


def google_books(answers: DataFrame, key: str, json: str = "json") -> DataFrame:
    schema = "items array<struct<volumeInfo:struct<title:string,authors:array<string>,publisher:string,publishedDate:string,pageCount:string>>>"
    rows = answers.select(key, F.explode(F.from_json(json, schema)["items"]).alias("i")).select(key, "i.volumeInfo.*")
    pages = F.when(F.coalesce("pageCount", F.lit("0")) != "0", F.concat("pageCount", F.lit(" p.")))
    return _record(rows, key, titulo=F.coalesce("title", F.lit("")), ano=F.substring(F.coalesce("publishedDate", F.lit("")), 1, 4), editora=F.col("publisher"), paginas_totais=pages, tipo=F.lit("livro"), autores=_people("authors"))


def open_library(answers: DataFrame, key: str, json: str = "json") -> DataFrame:
    schema = "docs array<struct<title:string,author_name:array<string>,first_publish_year:string>>"
    rows = answers.select(key, F.explode(F.from_json(json, schema)["docs"]).alias("d")).select(key, "d.*")
    return _record(rows, key, titulo=F.coalesce("title", F.lit("")), ano=F.coalesce("first_publish_year", F.lit("")), tipo=F.lit("livro"), autores=_people("author_name"))


def _people(names: str) -> Column:
    """The first six names that are not blank, as persons."""
    some = F.filter(F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, 6), lambda n: F.trim(n) != "")
    return F.transform(some, person)


def crossref(answers: DataFrame, key: str, json: str = "json") -> DataFrame:
    schema = "message struct<items:array<struct<title:array<string>,author:array<struct<given:string,family:string>>,publisher:string,`container-title`:array<string>,page:string,issued:struct<`date-parts`:array<array<int>>>>>>"
    rows = answers.select(key, F.explode(F.from_json(json, schema)["message"]["items"]).alias("i")).select(key, "i.*")
    rows = rows.withColumn("titulo", F.coalesce(F.get("title", F.lit(0)), F.lit("")))
    people = F.slice(F.coalesce("author", F.expr("array()").cast("array<struct<given:string,family:string>>")), 1, 10)
    authors = F.transform(people, lambda a: F.struct(F.coalesce(a["family"], F.lit("")).alias("sobrenome"), F.coalesce(a["given"], F.lit("")).alias("nome")))
    year = F.get(F.get(F.col("issued")["date-parts"], F.lit(0)), F.lit(0))
    return _record(rows, key, titulo=F.col("titulo"), ano=F.coalesce(year.cast("string"), F.lit("")), editora=F.col("publisher"), revista=F.coalesce(F.get("container-title", F.lit(0)), F.lit("")), tipo=F.lit("artigo"), autores=authors)
