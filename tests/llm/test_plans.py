"""What plans must not hold."""

import pytest

from placeflow.llm import decontaminate, linededup, lm, packing, pii, similar, simhash, warc
from placeflow.llm.common import table


def plan(df):
    return df._jdf.queryExecution().toString()


OPERATORS = {
    "lines": lambda docs, _: linededup.drop_shared_lines(docs), "simhash": lambda docs, _: simhash.near_duplicates(docs), "similar": lambda docs, _: similar.keep_one(docs),
    "templates": lambda docs, read: decontaminate.contaminated(docs, read("benchmark")), "model": lambda docs, _: lm.score(docs), "pack": lambda docs, _: packing.pack(docs),
    "pii": lambda docs, _: pii.find_pii(docs), "warc": lambda _, read: warc.deduplicate(read("pages")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_products_and_no_broadcast_of_texts(spark, sf_dir, name):
    df = OPERATORS[name](table(spark, sf_dir, "documents"), lambda t: table(spark, sf_dir, t))
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
    assert not any("BroadcastExchange" in line and "text" in line for line in text.split("\n"))


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan(simhash.fingerprints(table(spark, sf_dir, "documents")))
    scan = text[text.index("ReadSchema") :].split("\n")[0]
    assert "lang" not in scan and "source" not in scan
