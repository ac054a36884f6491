"""Every stage of the pipeline against plain Python, on the smallest tables with awkward rows; queries against their SQL."""

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import html, pii, quality, queries, toxicity

from .test_exact import _decontaminated
from .test_whole import _kept

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside.
CLASH = ("component", "mark", "label_id", "gone_doc_id", "id", "bits", "score", "held", "blob", "tie", "row", "spans")


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    first, long = (r.text for r in plain.filter("length(text) > 400").orderBy("doc_id").limit(2).collect())
    odd = [
        (None, first + " and a few words more"), (None, None), (90001, None), (90002, ""), (90003, " \n\t "), (90004, "one"), (90005, first), (90005, first),
        (90006, first + " changed"), (90007, long + "\n" + long), (90008, f"{' '.join(reversed(long.split()))} {bench}"), (90009, "Write to bob@example.org or call +1 555 010 9999. " + long[::-1]),
        (90010, " ".join(f"w{k}" for k in range(30_000))), (90011, first.upper()),
    ]
    made = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in odd], plain.schema)
    both = plain.unionByName(made)
    return both.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(5).cache()


def _pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def test_stages_against_plain_python(spark, docs):
    rows = docs
    stages = dict(corpus_pipeline.STAGES)
    before = _pairs(rows)

    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = stages["quality classifier"](spark, rows, SF).cache()
    assert kept.columns == docs.columns
    assert _pairs(kept) == [r for r in before if model.score(np.array([quality.features(r[1] or "")]))[0] >= 0.3]
    assert kept.count() > 150

    # All rows go on, so that the other stages meet the awkward ones too.
    kept = stages["near duplicates"](spark, rows, SF).cache()
    assert kept.columns == docs.columns
    texts = {}
    for d, t in before:
        if d is not None:
            texts.setdefault(d, t or "")
    stay = set(_kept(sorted(texts.items())))
    assert _pairs(kept) == [r for r in before if r[0] is None or r[0] in stay]
    assert 90007 not in stay and 90008 in stay

    after, rows = _pairs(kept), kept
    kept = stages["benchmark decontamination"](spark, rows, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {(d, t) for d, t in after if _decontaminated([(d, t or "")], items)[0][-1]}
    assert kept.columns == docs.columns and _pairs(kept) == [r for r in after if r not in hit]
    assert any(d == 90008 for d, _ in hit)

    after, rows = _pairs(kept), kept
    kept = stages["personal data"](spark, rows, SF).cache()
    assert kept.columns == docs.columns
    masked = _pairs(kept)
    assert sorted(str(d) for d, _ in masked) == sorted(str(d) for d, _ in after)
    by = dict(masked)
    for d, t in after:
        if d is not None:
            assert (by[d] is None) == (t is None)
            if t and not re.search("[0-9@]", t):
                assert by[d] == t
            assert not pii.find(by[d] or "")
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)
    assert "<EMAIL>" in by[90009] and "<PHONE>" in by[90009]

    packed = stages["best-fit packing"](spark, kept, SF).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    length = sorted(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in masked)
    ends = {}
    for r in packed:
        ends[r.doc_id] = ends.get(r.doc_id, 0) + r.length
    assert sum(ends.values()) == sum(length)


def test_stages_of_nothing(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda f: sorted(map(str, f[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)


def test_operators_of_empty_tables(spark, docs):
    none = docs.limit(0)
    assert pii.scan(none).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(none, labels).score(["any", ""]).tolist() == [0.5, 0.5]
    assert quality.fit(none, labels).score(np.array([quality.features("any")])).tolist() == [0.5]


def test_long_texts_keep_their_base_spans(spark):
    """A long text of ordinary words with personal data all over it, against the plain patterns."""
    text = " ".join(f"word{k % 7}a, mail{k}@ex-am.ple.org and 10.0.{k % 300}.7 or 4111 1111 1111 1111; +1 (555) 010-{1000 + k}." if k % 50 == 0 else "some words here." for k in range(6000))
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    found = pii.find(text)
    assert [s for s in found if s[1] != 2] == sorted(want)
    assert sum(s[1] == 2 for s in found) == 120
    field = pii.fit(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert set(pii.additional(text, found, field)) - set(found) == set(pii.additional(text, found, field))


def test_field_is_learned(spark):
    """Trained on texts that the patterns label, the field finds a repeated card in a form that they miss, and no stray number."""
    rng = np.random.default_rng(3)

    def card():
        d = [4, *rng.integers(0, 10, 14).tolist()]
        total = sum(sum(divmod(2 * c, 10)) if k % 2 == 0 else c for k, c in enumerate(reversed(d)))
        return "".join(map(str, [*d, -total % 10]))

    texts = []
    for k in range(400):
        c = card()
        texts.append((k, f"paid with {c} in version 3. and again {c} of 12 items, see page {k}"))
        texts.append((1000 + k, f"call +1 555 010 {1000 + k} for version 3. or 42 more, room {k % 90}, code 77{k}"))
    field = pii.fit(spark.createDataFrame(texts, "doc_id long, text string"))
    c = card()
    text = f"paid with {c} in version 3. and again {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} of 12 items"
    base = pii.find(text)
    assert [text[a:b] for a, _, b in base] == [c]
    assert [(text[a:b], pii.KINDS[k]) for a, k, b in pii.additional(text, base, field)] == [(f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", "card")]
    for t in ("call +1 555 010 9999 for version 3. or 42", "license, version 3.", "room 12, page 7"):
        assert pii.additional(t, pii.find(t), field) == []
    assert np.trace(field.skip[1:, 1:]) > field.skip[0, 1:].sum()


def test_covered_tokens():
    tokens = [(0, 3), (5, 9), (10, 12), (20, 30)]
    assert pii.covered(tokens, [(6, 3, 11), (2, 0, 4), (8, 2, 9), (25, 1, 26)]) == [1, 3, 4, 2]
    assert pii.covered(tokens, []) == [None] * 4 and pii.covered([], [(0, 0, 3)]) == []


def test_html_layouts_beyond_the_made_ones(spark):
    tree = html.train()
    deep = "<article><p>One two three four.</p>" + "<div>" * 900 + "<p>Deep words are here, too.</p>" * 4 + "</div>" * 900 + "</article>"
    assert html.main_text(deep, tree).count("\n") == 4
    cases = {
        "<article><p>a</p><svg/><p>b</p><math/><p>c</p></article>": "a\nb\nc",
        "<article><p>a</p><svg><svg></svg><text>x</text></svg><p>b</p></article>": "a\nb",
        "<article><p>a</p><!--><p>b</p><!-- x --!><p>c</p></article>": "a\nb\nc",
        "<article><p>a</p><select><option>no</select><object>z</object><p>b</p></article>": "a\nb",
        "<article><h1>Title of it</h1><div>short</div><div><table><tr><td>x one<td>y two</tr></table></div><details><summary>More</summary><p>Some words here.</p></details><p>Last words.</p></article><footer>(c) 2020</footer>": "Title of it\nshort\nx one\ny two\nMore\nSome words here.\nLast words.",
    }
    for page, text in cases.items():
        assert html.main_text(page, tree) == text
    rows = spark.createDataFrame([(1, "u", next(iter(cases)), "clash")] * 3, "page_id long, url string, html string, text string")
    assert [r.text for r in html.extract(rows, tree).collect()] == ["a\nb\nc"] * 3
