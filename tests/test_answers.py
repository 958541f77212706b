"""Objects, texts and references found in model answers."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import answers

GOLDEN = '{"definitions":[{"term":"tenepes","meaning":"tarefa energetica pessoal"}],"related_terms":["assistencialidade","interassistencia"],"disambiguated_query":"tenepes no contexto da assistencialidade conscienciologica"}'


def of(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_query_context(spark):
    whole, other, none = of(spark, [GOLDEN, '{"definitions":[{"term":" t ","meaning":"m"},{"term":"","meaning":"x"},5],"related_terms":["a ","b","a",3,null,0,true,1.5],"disambiguated_query":7}', "no object"], answers.query_context)
    assert whole.used and whole.definitions[0].term == "tenepes" and whole.related_terms == ["assistencialidade", "interassistencia"] and whole.disambiguated_query.startswith("tenepes no contexto")
    assert [tuple(d) for d in other.definitions] == [("t", "m")] and other.related_terms == ["a", "b", "3", "True", "1.5"] and other.disambiguated_query == "7"
    assert not none.used and (none.definitions, none.related_terms, none.disambiguated_query, none.references) == ([], [], "", [])


@pytest.mark.parametrize("deep", [False, True])
def test_where_objects_stand(spark, deep):
    texts = ['{"a": 1}', ' x ```JSON\n{"a": 2}\n``` {y', '```\n{bad}\n```\n```{"a": 3}```', 'say {"a": 4} so', '[{"a": 5}]', "[1]", '"{}"', "", None, "{", '{"a": 1} and {"a": 6}', '{x} "{ {"a": "}\\"}", "b": {}} }']
    got = [None if v is None else json.loads(v) for v in of(spark, texts, lambda t: answers.json_block(t, deep).cast("string"))]
    assert got[:10] == [{"a": 1}, {"a": 2}, {"a": 3}, {"a": 4}, {"a": 5}, None, {}, None, None, None]
    assert got[10:] == ([{"a": 1}, None] if deep else [None, None])


def plain_balanced(text):
    out, depth, quoted, start, i = [], 0, False, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 2
            continue
        if c == '"' and depth:
            quoted = not quoted
        elif c == "{" and not quoted:
            start, depth = (i, 1) if not depth else (start, depth + 1)
        elif c == "}" and not quoted and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
        i += 1
    return out


def test_balanced_blocks(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice('{}"\\a\n{}') for _ in range(rng.randrange(40))) for _ in range(300)]
    assert of(spark, texts, answers.balanced) == [plain_balanced(t) for t in texts]


def test_responses(spark):
    payloads = [
        {"output": [{"type": "file_search_call", "results": [{"file_id": "f1"}, {"filename": " ", "title": "x"}, 7]}, {"type": "message", "content": [{"type": "Output_Text", "text": " a "}, {"type": "text", "text": {"value": "b"}, "annotations": [{"type": "file_citation", "attributes": {"book": "B"}}, {"type": "file_citation", "title": "x"}, {"type": "url"}]}, {"type": "image", "text": "no"}], "text": "own"}]},
        {"output": [], "output_text": ["x", " ", "y"]}, {"output_text": {"value": " v "}}, {"output_text": "s "}, {}, {"output": 5, "output_text": 0}, {"output": [3, {"text": {"value": "w"}, "content": 1}], "output_text": "unused"},
    ]
    texts = [json.dumps(p) for p in payloads]
    assert of(spark, texts, lambda t: answers.response_text(F.parse_json(t))) == ["a\nb\nown", "x\ny", "v", "s", "", "", "w"]
    assert of(spark, texts, lambda t: answers.response_references(F.parse_json(t)))[:2] == [["f1", "x", "B"], []]
