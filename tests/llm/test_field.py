"""The field over tokens of personal data, against what its weights say."""

import numpy as np

from granary.llm import pii


def test_field_runs_where_the_patterns_find_nothing(spark):
    unary = np.zeros((pii.FEATURES, pii.LABELS))
    unary[0, 0], unary[2, 1] = 3.0, 9.0  # an @ with a dot after it: an email
    field = pii.Field(unary, np.zeros((5, 5)), np.zeros((5, 5)))
    texts = ["write to andré@mail.fr today", "write to andré@mail.fr or bob@ex.org", "nothing 12 here", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.scan(docs, field).collect()}
    assert spans == {0: "email:9:22", 1: "email:9:22,email:26:36", 2: "", 3: "", 4: ""}
    masked = {r.doc_id: r.text for r in pii.mask(docs, field).collect()}
    assert masked == {0: "write to <EMAIL> today", 1: "write to <EMAIL> or <EMAIL>", 2: "nothing 12 here", 3: "", 4: None}
