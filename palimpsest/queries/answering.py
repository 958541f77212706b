"""Objects, texts and references of model answers, which Spark makes of the turns of `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import answers
from palimpsest.queries.common import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _answers(spark, sf_dir):
    """conv_id, turn, answer: an object as it is, fenced, amid words, after a broken one, in a list; or none."""
    c = table(spark, sf_dir, "conversations")
    words = F.split(F.regexp_replace("text", r"[\s.,;:!?]+", " "), " ")
    made = F.struct(
        F.array(F.struct(F.col("role").alias("term"), F.col("text").alias("meaning")), F.struct(F.lit("").alias("term"), F.col("text").alias("meaning"))).alias("definitions"),
        F.slice(words, 1, 20).alias("related_terms"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  about "), words[0])).alias("disambiguated_query"),
    )
    json, kind = F.to_json(made), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    forms = [json, F.concat(F.lit("Here:\n```json\n"), json, F.lit("\n```\nDone {or not}.")), F.concat(F.lit("I think "), json, F.lit(" is right.")), F.concat(F.lit("{broken} "), json), F.concat(F.lit("["), json, F.lit("]")), F.lit("[1, 2]")]
    return c.select("conv_id", "turn", F.get(F.array(*forms), kind.cast("int")).alias("answer"), "text")


@R.add(r"""WITH c AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 7 AS kind, string_split(regexp_replace(text, '[\s.,;:!?]+', ' ', 'g'), ' ') AS words FROM conversations),
told AS (SELECT conv_id, turn, json_object('definitions', [json_object('term', role, 'meaning', text), json_object('term', '', 'meaning', text)], 'related_terms', words[:20], 'disambiguated_query', CASE WHEN turn % 2 = 0 THEN '  about ' || words[1] END)::VARCHAR AS j, kind FROM c),
answers AS (SELECT conv_id, turn, CASE kind WHEN 0 THEN j WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' || chr(10) || 'Done {or not}.' WHEN 2 THEN 'I think ' || j || ' is right.' WHEN 3 THEN '{broken} ' || j WHEN 4 THEN '[' || j || ']' WHEN 5 THEN '[1, 2]' END AS answer FROM told),
tried AS (SELECT conv_id, turn, list_filter(list_transform([trim(answer)] || regexp_extract_all(answer, '(?si)```(?:json)?\s*(\{.*?\})\s*```', 1) || [regexp_extract(answer, '(?s)(\{.*\})', 1)], lambda x: TRY_CAST(nullif(x, '') AS JSON)), lambda x: json_type(x) = 'OBJECT')[1] AS o FROM answers),
parts AS (SELECT conv_id, turn, o, list_filter(list_transform(from_json(o->'definitions', '[{"term":"VARCHAR","meaning":"VARCHAR"}]'), lambda d: {'term': trim(d.term), 'meaning': regexp_replace(d.meaning, '^\s+|\s+$', '', 'g')}), lambda d: d.term <> '' AND d.meaning <> '') AS ds,
  list_filter(from_json(o->'related_terms', '["VARCHAR"]'), lambda t: t <> '') AS ts, trim(coalesce(o->>'disambiguated_query', '')) AS q FROM tried)
SELECT conv_id, turn, coalesce(len(ds), 0) > 0 OR coalesce(len(ts), 0) > 0 OR q <> '' AS used, coalesce(len(ds), 0)::INTEGER AS n_definitions, ds[1].term AS term, md5(ds[1].meaning) AS meaning_md5,
  coalesce(array_to_string(list_filter(ts, lambda t, i: list_position(ts, t) = i)[:12], ','), '') AS terms, q AS disambiguated_query FROM parts""")
def ans_query_context(spark, sf_dir):
    x = _answers(spark, sf_dir).withColumn("c", answers.query_context(F.col("answer")))
    first = F.get(F.col("c.definitions"), F.lit(0))
    return x.select("conv_id", "turn", "c.used", F.size("c.definitions").alias("n_definitions"), first["term"].alias("term"), F.md5(first["meaning"]).alias("meaning_md5"), F.array_join("c.related_terms", ",").alias("terms"), "c.disambiguated_query")


def _responses(spark, sf_dir):
    """conv_id, payload: a response of a conversation, its turns in order as output items of several forms."""
    c = table(spark, sf_dir, "conversations")
    no = F.lit(None)
    cited = F.array(
        F.struct(F.lit("file_citation").alias("type"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("f"), F.col("conv_id") % 5)).alias("filename"), F.struct(F.concat(F.lit("b"), F.col("turn")).alias("book")).alias("attributes")),
        F.struct(F.lit("url_citation").alias("type"), F.lit("not told").alias("filename"), F.struct(no.cast("string").alias("book")).alias("attributes")),
    )
    text = F.parse_json(F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("value")))).otherwise(F.to_json(F.struct("text"))))
    block = F.struct(F.when(F.col("role") == "user", "image").when(F.col("turn") % 4 == 1, " Output_Text").otherwise("text").alias("type"), F.coalesce(F.try_variant_get(text, "$.text", "variant"), text).alias("text"), cited.alias("annotations"))
    item = F.struct(F.when(F.col("role") == "user", "file_search_call").otherwise("message").alias("type"), F.array(F.struct(F.lit(" ").alias("title"), F.concat(F.lit("id"), F.col("turn") % 2).alias("file_id"))).alias("results"), F.array(block).alias("content"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(item).alias("item")))).alias("items"))
    json = F.concat(F.lit('{"output":['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit('],"output_text":["none of ","these"]}'))
    return rows.select("conv_id", F.parse_json(json).alias("payload"))


@R.add(r"""WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations),
texts AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'user' AND text <> '') AS x FROM t GROUP BY conv_id),
refs AS (SELECT conv_id, turn, 0 AS k, 'id' || (turn % 2) AS label FROM t WHERE role = 'user' UNION ALL SELECT conv_id, turn, 1, CASE WHEN turn % 3 = 0 THEN 'f' || (conv_id % 5) ELSE 'b' || turn END FROM t),
once AS (SELECT conv_id, label, min((turn, k)) AS first FROM refs GROUP BY ALL),
told AS (SELECT conv_id, string_agg(label, ',' ORDER BY first) AS refs FROM once GROUP BY conv_id)
SELECT conv_id, md5(coalesce(x, 'none of' || chr(10) || 'these')) AS text_md5, refs AS "references" FROM texts JOIN told USING (conv_id)""")
def ans_responses(spark, sf_dir):
    r = _responses(spark, sf_dir)
    return r.select("conv_id", F.md5(answers.response_text(F.col("payload"))).alias("text_md5"), F.array_join(answers.response_references(F.col("payload")), ",").alias("references"))
