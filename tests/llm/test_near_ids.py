"""Near duplicates where doc_ids are null or repeated: no class is lost with another's id."""

from helpers import SCHEMA, filler
from lucera.llm import jaccard_join


def test_one_document_of_each_class(spark):
    texts = [filler(80, k) for k in range(40, 46)]
    near = texts[1].split()
    near[40] = "changed"
    rows = [
        (None, texts[0]), (None, texts[1]), (None, " ".join(near)), (10, texts[2]), (10, texts[3]), (10, texts[3]), (11, texts[3]),
        (None, texts[4]), (3, texts[4]), (12, None), (12, ""), (None, texts[5]),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", 7, "h") for d, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"] or "") for r in jaccard_join.stage(spark, docs, "").collect()]
    pair = {(None, texts[1]), (None, " ".join(near))}
    assert len(pair & set(got)) == 1
    expect = [(None, texts[0]), (10, texts[2]), (10, texts[3]), (3, texts[4]), (12, ""), (None, texts[5])]
    assert sorted(map(str, set(got) - pair)) == sorted(map(str, expect)) and len(got) == len(expect) + 1
