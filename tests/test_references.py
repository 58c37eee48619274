"""References in JSON: read apart from the text where they are plain, and alike in every other form."""

from episodica.operators import store

A = '"event_id":"e","patient_id":"p"'
FORMS = {
    '{%s,"references":{"a":"x"}}': {"a": "x"},
    '{%s,"references" : { "a" : "x" ,\n "b, {":"y"} }': {"a": "x", "b, {": "y"},
    '{"references":{"ä":"ü€"},%s,"attributes":{"q":"1"}}': {"ä": "ü€"},
    '{%s,"attributes":{"z":"{"},"references":{"a":"x"}}': {"a": "x"},
    '{%s,"references":{}}': {},
    '{%s,"references":["a"]}': {"a": "references"},
    '{%s,"references":{"a\\"b":"x"}}': {'a"b': "x"},
    '{%s,"attributes":{"references":{"a":"x"}}}': {},
    '{%s,"attributes":{"z":"}","references":{"a":"x"}}}': {},
    "{%s,'event_type':'k, \"references\":{\"a\":\"x\"} '}": {},
    '{%s,"references":{"a":"x"},"references":["q"]}': {"q": "references"},
    '{%s,"references":["q"],"references":{"a":"x"}}': {"a": "x"},
    '{%s,"references":{"a":"x"},"\\u0072eferences":{"b":"y"}}': {"b": "y"},
    '{%s,"references":{"a":"x"},"references":null}': {},
}


def test_every_form(spark):
    for form, wanted in FORMS.items():
        rows = spark.createDataFrame([(form.replace("%s", A),)], "json string")
        assert [r.references for r in store.from_json(rows).collect()] == [wanted], form


def test_parser_meets_no_ids(spark):
    rows = spark.createDataFrame([('{%s,"references":{"id%d":"part_of","other%d":"confirms"}}' % (A, k, k),) for k in range(20)], "json string")
    assert all("id" not in r.json.replace("event_id", "").replace("patient_id", "") for r in store._without_links(rows).collect())
