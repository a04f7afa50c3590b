"""Exact values and edge cases of the library's operators."""

import json
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attestor.functions import stats as S
from attestor.functions import text as T
from attestor.functions.kleene import k_and, k_or
from attestor.operators import answers, context, evaluation, passages, retrieval
from attestor.sources import articles, artifacts
from attestor.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


def test_chunk_windows_and_numbers(spark):
    docs = spark.createDataFrame([("d", "one two three four five"), ("e", "a\n\n \n\nb")], "document_id string, text string")
    found = {r.passage_id: r.text for r in passages.chunk(docs, 2).collect()}
    assert found == {"d:p1:w0": "one two", "d:p1:w2": "three four", "d:p1:w4": "five", "e:p1:w0": "a", "e:p3:w0": "b"}


def test_words_follow_unicode_white_space(spark):
    text = "a b c\x1cd​e"
    assert value(spark, T.words(F.lit(text))) == text.split()


def test_terms_bridge_stop_words(spark):
    docs = spark.createDataFrame([(1, "Élan of the été_1 a ab often Of"), (2, "")], "id long, text string")
    found = {r.term: r.tf for r in retrieval.term_counts(docs, ["id"]).collect()}
    assert found == dict.fromkeys(["élan", "été_1", "ab", "often", "élan été_1", "été_1 ab", "ab often"], 1)


@pytest.mark.parametrize("text", ["", "plain", 'q"\\\n\t\r\b\f', "é\x7f\x01 ∆", "😀 and ü"])
def test_json_length(spark, text):
    assert value(spark, T.json_string_length(F.lit(text))) == len(json.dumps(text))
    item = {"id": "a:p1:w0", "kind": "technical", "text": text}
    n = value(spark, T.json_item_length(F.lit(item["id"]), F.lit(item["kind"]), F.lit(text)))
    assert n == len(json.dumps(item))
    assert value(spark, T.json_list_length(F.lit(3 * n), F.lit(3))) == len(json.dumps([item] * 3))


def test_kleene_keeps_unknown(spark):
    rows = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, True)], "g int, v boolean")
    found = {r.g: (r.a, r.o) for r in rows.groupBy("g").agg(k_and(F.col("v")).alias("a"), k_or(F.col("v")).alias("o")).collect()}
    assert found == {1: (None, True), 2: (False, None), 3: (True, True)}


@pytest.mark.parametrize(("gains", "losses", "p"), [(5, 0, 0.0625), (9, 1, 0.021484375), (7, 1, 0.0703125), (17, 0, 1.52587890625e-05), (0, 0, 1.0), (3000, 3000, 1.0)])
def test_mcnemar(spark, gains, losses, p):
    assert value(spark, S.mcnemar(F.lit(gains), F.lit(losses))) == pytest.approx(p, rel=1e-9)


def test_intervals(spark):
    assert S.binomial_interval(29, 36) == pytest.approx((0.6397519918, 0.9180563608), abs=1e-8)
    assert S.binomial_interval(0, 5)[0] == 0 and S.binomial_interval(5, 5)[1] == 1 and S.binomial_interval(0, 0) is None
    row = spark.range(1).select(S.clopper_pearson(F.lit(29), F.lit(36)).alias("i")).head().i
    assert row.low == pytest.approx(0.6397519918, abs=1e-8)


def test_holm(spark):
    p = [0.0703125, 0.021484375, 0.5]
    tests = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    assert [r.p_holm for r in evaluation.holm(tests, "p", ["i"]).orderBy("i").collect()] == pytest.approx([0.140625, 0.064453125, 0.5])


def test_outcomes(spark):
    rows = [(None, None, True, [0.5, 0.0]), (None, None, True, [-0.5, None]), (None, None, True, [0.1, -0.1]), (None, None, True, [None, 0.0]), (None, None, True, [None, None]), (None, "e", True, [0.5]), ("e", None, True, [0.5]), ("e", "e", False, [0.5]), (None, None, False, [0.5])]
    made = spark.createDataFrame(rows, "a string, b string, ok boolean, d array<double>")
    found = [r.o for r in made.select(S.paired_outcome(F.col("a").isNotNull(), F.col("b").isNotNull(), F.col("ok"), F.col("d")).alias("o")).collect()]
    assert found == ["improved", "worsened", "mixed", "unchanged", "not-scored", "failed", "recovered", "both-failed", "unavailable"]


def test_a_comparison_needs_the_same_cases(spark):
    side = lambda ids: spark.createDataFrame([(i, None, True, 0.5) for i in ids], "case_id int, error string, available boolean, recall double")
    assert [r.outcome for r in evaluation.paired_changes(side([1, 2]), side([2, 1]), "case_id", ["recall"]).collect()] == ["unchanged"] * 2
    for other in ([1], [1, 2, 3], [1, 2, 2]):
        with pytest.raises(PySparkException, match="each case once"):
            evaluation.paired_changes(side([1, 2]), side(other), "case_id", ["recall"]).collect()


def test_intervals_of_large_counts():
    low, high = S.binomial_interval(500_000, 1_000_000)
    assert (low, high) == pytest.approx((0.5 - 0.00098, 0.5 + 0.00098), abs=2e-6)
    assert S.exact_p(5_000_000, 5_004_000) == pytest.approx(0.2061, abs=1e-3) and S.exact_p(10, 2_000_000) < 1e-300
    with pytest.raises(ValueError):
        S.binomial_interval(4, 3)


def test_fusion_and_rerank(spark):
    lists = [spark.createDataFrame([(0, i, r) for r, i in enumerate(x, 1)], "q long, id long, rank int") for x in ([0, 1, 2], [3, 1, 2])]
    fused = retrieval.ranked(retrieval.reciprocal_rank_fusion([(lists[0], 1.0), (lists[1], 1.0)], ["q", "id"]), 4, "q", "score", ["id"])
    rows = fused.orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 2, 0, 3] and rows[0].score == pytest.approx(2 / 62)
    pool = spark.createDataFrame([(0, 2, 1), (0, 1, 2), (0, 0, 3)], "q long, id long, rank int")
    scores = spark.createDataFrame([(0, 2, 5.0), (0, 1, 1.0), (0, 0, 5.0)], "q long, id long, score double")
    assert [r.id for r in retrieval.rerank(pool, scores, ["q", "id"], 2, "q", ["id"]).orderBy("rank").collect()] == [0, 2]


def test_diverse_choice(spark):
    pool = spark.createDataFrame([(0, 0, 1, [1.0, 0.0]), (0, 1, 2, [1.0, 0.0]), (0, 2, 3, [0.0, 1.0])], "query_id long, candidate_id long, rank int, vector array<double>")
    assert [r.candidate_id for r in retrieval.diverse(pool, 3, 0.5).orderBy("rank").collect()] == [0, 2, 1]


def test_dense_order_and_ties(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i != 3 else [0.0, 1.0]) for i in range(5)], "vec_id long, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, vector array<double>")
    found = retrieval.dense(queries, vectors, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(7, 0), (7, 1), (8, 3), (8, 0)]
    assert retrieval.dense(queries.limit(0), vectors, 2).count() == 0


def test_tfidf_finds_the_passage_and_nothing_else(spark):
    docs = spark.createDataFrame([("p1", "dust causes false positives in dark field imaging"), ("p2", "bright field imaging shows contrast")], "passage_id string, text string")
    asked = spark.createDataFrame([(1, "Does dust cause false positives?"), (2, "Who composed symphonies?")], "q long, text string")
    rows = retrieval.ranked(retrieval.tfidf(docs, asked, ["passage_id"], "q"), 4, "q", "score", ["passage_id"]).collect()
    assert [(r.q, r.passage_id) for r in rows] == [(1, "p1")]


def test_budgets(spark):
    hits = spark.createDataFrame([(0, "a", 1, 100), (0, "b", 2, 300), (0, "c", 3, 50)], "q long, passage_id string, rank int, item_chars int")
    assert [r.passage_id for r in context.character_budget(hits, 200, "q").collect()] == ["a"]
    assert [r.passage_id for r in context.passage_budget(hits, 200, "q").orderBy("rank").collect()] == ["a", "c"]
    assert context.character_budget(hits, 101, "q").count() == 0
    assert [r.passage_id for r in context.character_budget(hits, 102, "q").collect()] == ["a"]
    assert [r.passage_id for r in context.omitted(hits, context.character_budget(hits, 200, "q"), ["q", "passage_id"]).orderBy("rank").collect()] == ["b", "c"]
    assert context.MIN_BUDGET == 7000


def test_adjacent_ranges_cover_a_span_jointly(spark):
    spans = spark.createDataFrame([(1, 0, 0, "p", 2, 8), (1, 0, 1, "x", 0, 1), (1, 1, 0, "n", 0, 1)], "q long, group_id int, alternative int, passage_id string, start int, end int")
    supplied = spark.createDataFrame([(1, "p"), (1, "n")], "q long, passage_id string")
    ranges = spark.createDataFrame([("p", [(0, 5), (5, 9)])], "passage_id string, retained array<struct<start int, end int>>")
    seen = evaluation.span_visibility(spans, supplied, ranges, "q")
    assert {r.passage_id: r.visible for r in seen.collect()} == {"p": True, "x": False, "n": None}
    groups, cases = evaluation.evidence_coverage(seen, "q")
    assert {r.group_id: r.covered for r in groups.collect()} == {0: True, 1: None}
    assert cases.head().coverage is None and cases.head().complete is None


def test_citations(spark):
    f = lambda j, same, ok: value(spark, answers.citation_value(F.lit(j).cast("boolean"), F.lit(same), F.lit(ok)))
    assert [f(True, False, True), f(True, False, False), f(False, False, False), f(None, False, True), f(False, True, False)] == [True, None, False, None, True]
    assert value(spark, answers.quote_verified(F.lit("Δt  is"), F.lit("the ∆t\nis® small"))) is True


MATH = {
    "<math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math>": "E = m (c)^(2)",
    "<math><msubsup><mi>a</mi><mi>i</mi><mn>3</mn></msubsup></math>": "(a)_(i)^(3)",
    "<mfrac><mrow><mi>p</mi><mo>+</mo><mn>7</mn></mrow><mi>q</mi></mfrac>": "(p + 7) / (q)",
    "<munder><mo>lim</mo><mi>n</mi></munder>": "under(lim; n)",
    "<mfenced open='[' close=')'><mn>4</mn><mn>9</mn></mfenced>": "[4 , 9)",
    "<mfenced separators='| /'><mi>u</mi><mi>v</mi><mi>w</mi><mi>z</mi></mfenced>": "(u | v / w / z)",
    "<mfenced separators=' '><mi>g</mi><mi>h</mi></mfenced>": "(g h)",
    "<mrow><mi mathvariant='script'>L</mi><mspace width='1em'/><mtext>of</mtext><mi mathvariant='italic'>f</mi></mrow>": "script(L) of f",
    "<mtable><mtr><mtd><mi>r</mi></mtd></mtr><mtr><mtd><mi>s</mi></mtd></mtr></mtable>": "[[r]; [s]]",
}
#: An operator that isn't read, a missing operand, a token with markup inside, loose text, a negative space, no content.
UNREADABLE = [
    "<mroot><mi>b</mi><mn>5</mn></mroot>", "<msub><mi>lonely</mi></msub>", "<mn>8<mi>k</mi></mn>", "<mrow><mi>y</mi>loose</mrow>", "<mrow><mspace width='-2em'/><mi>t</mi></mrow>",
    "<mrow></mrow>", "<mfrac linethickness='2pt'><mi>e</mi><mi>f</mi></mfrac>", "<mtable><mi>j</mi></mtable>", "<mi mathvariant='fraktur'>m</mi>",
]


@pytest.mark.parametrize(("markup", "text"), MATH.items())
def test_formulas(markup, text):
    assert articles.formula(ET.fromstring(markup)) == text


@pytest.mark.parametrize("inner", UNREADABLE)
def test_formulas_that_cannot_be_read(inner):
    node = ET.fromstring(f"<p>as in <inline-formula><math>{inner}</math></inline-formula> above</p>")
    assert articles.prose(node) == (f"as in {articles.OMITTED} above", 0, 1)
    assert articles.prose(node, readable=False) == (f"as in {articles.OMITTED} above", 0, 0)


ARTICLE = """<article><front><article-meta><article-id pub-id-type="pmid">9</article-id><article-id pub-id-type="doi">10.1/AB</article-id><title-group><article-title>On <i>moss</i></article-title></title-group>
<contrib-group><contrib><string-name><surname>Okafor</surname><given-names>Ada</given-names></string-name></contrib><contrib contrib-type="author"><role>Section Editor</role><name><surname>Q</surname></name></contrib>
<contrib contrib-type="reviewer"><name><surname>R</surname></name></contrib></contrib-group>
<pub-date><year>2019</year><month>12</month></pub-date><pub-date><day>7</day><month>2</month><year>2022</year></pub-date>
<permissions><copyright-statement>(c) Okafor</copyright-statement><license><p>See https://licence.example/by</p></license></permissions><abstract><p>Moss grows.</p></abstract></article-meta></front>
<body><p>Before any section.</p><sec><p>It <b>likes</b> shade.</p><title>Where</title><fig><p>a picture</p></fig><sec><title>North</title><p>Cold &amp; wet<list><list-item><p>inner</p></list-item></list></p></sec></sec>
<sec><title>Funding Statement</title><p>money</p><sec><title>More</title><p>more money</p></sec></sec></body></article>"""
GATES = articles.Gates({"A1": "10.1/ab"}, "https://licence.example/by")


def test_articles(spark):
    files = spark.createDataFrame([("A1", ARTICLE.encode()), ("A2", b"<broken"), ("A3", b"<article><front><article-meta/></front><body><sec/></body></article>")], "id string, raw binary")
    rows = articles.paragraphs(files, "id", "raw")
    found = sorted((r.paragraph, r.section, r.locator, r.text) for r in rows.filter("error is null").collect())
    assert found == [
        (1, "Abstract", "./front/article-meta/abstract[1]/p[1]", "Moss grows."), (2, "", "./body/p[1]", "Before any section."),
        (3, "Where", "./body/sec[1]/p[1]", "It likes shade."), (4, "Where > North", "./body/sec[1]/sec[1]/p[1]", "Cold & wetinner"),
    ]
    document = articles.documents(rows).head()
    assert (document.id, document.title, document.authors, document.published, document.doi, document.copyright) == ("a1", "On moss", ["Ada Okafor"], "2022-02-07", "10.1/AB", "(c) Okafor")
    assert {r.document_id: r.error for r in rows.filter("error is not null").collect()}.keys() == {"A2", "A3"}


def test_gates_of_articles(spark):
    changes = {"DOI": ("10.1/AB", "10.1/other"), "licence": ("licence.example/by", "licence.example/nc"), "published": ("<day>7</day>", ""), "copyright": ("(c) Okafor", ""), "authors": ("string-name", "nickname"), "prose": ("<p>", "<q>")}
    files = [("A1", ARTICLE)] + [("A1", ARTICLE.replace(a, b).replace("</p>", "</q>") if b == "<q>" else ARTICLE.replace(a, b)) for a, b in changes.values()]
    rows = articles.paragraphs(spark.createDataFrame([(i, t.encode()) for i, t in files], "id string, raw binary"), "id", "raw", gates=GATES)
    errors = sorted(r.error for r in rows.filter("error is not null").collect())
    assert len(errors) == len(changes) and all(any(word in e for e in errors) for word in changes) and rows.filter("error is null").count() == 4


def test_rebuilding_a_corpus(spark):
    files = spark.createDataFrame([("A1", ARTICLE.encode())], "id string, raw binary")
    docs = articles.rebuild(files, GATES)
    records = articles.manifest(docs).withColumn("id", F.lit("A1"))
    assert records.head().paragraph_count == 4 and "licence.example" in records.head().permission_evidence
    assert articles.rebuild(files, GATES, records).count() == 1 and list(articles.notice(records)) == ["On moss. Ada Okafor. 2022-02-07. https://doi.org/10.1/AB. (c) Okafor"]
    with pytest.raises(ValueError, match="changed"):
        articles.rebuild(files.withColumn("raw", F.encode(F.lit(ARTICLE + " "), "utf-8")), GATES, records)
    with pytest.raises(ValueError, match="licence"):
        articles.rebuild(files, articles.Gates(license_url="https://other"))


def test_pages(spark):
    html = "<html><head><title>Tea</title><script>no()</script></head><body><nav><p>menu</p></nav><h1>Green</h1><p>Steep <b>two</b> minutes.<br>Drink.</p><ul><li>cup</li><li>pot</li></ul></body></html>"
    rows = articles.paragraphs(spark.createDataFrame([(1, html), (2, "<html><body></body></html>")], "id long, html string"), "id", "html", "html").orderBy("document_id", "paragraph").collect()
    assert [(r.title, r.section, r.text) for r in rows if r.error is None] == [("Tea", "Green", "Steep two minutes. Drink."), ("Tea", "Green", "cup"), ("Tea", "Green", "pot")]
    assert [(r.document_id, r.error) for r in rows if r.error] == [("2", "no prose")]


def test_artifacts(spark, tmp_path):
    target = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        artifacts.published(spark, target)
    for n in (3, 5, 7):
        artifacts.publish(spark.range(n), target)
        assert artifacts.published(spark, target).count() == n
    with pytest.raises(PySparkException):
        artifacts.publish(spark.range(4).select(F.raise_error(F.lit("stop"))), target)
    assert artifacts.published(spark, target).count() == 7
    artifacts.write_text(str(tmp_path / "note"), "one")
    artifacts.write_text(str(tmp_path / "note"), "two")
    assert (tmp_path / "note").read_text() == "two"
    assert artifacts.canonical_hash({"b": 1, "a": "é"}) == artifacts.canonical_hash({"a": "é", "b": 1})
    assert artifacts.same_rows(spark.range(3), spark.range(3)) and not artifacts.same_rows(spark.range(3), spark.range(4))
    artifacts.write_bundle(spark.range(3), str(tmp_path / "bundle"))
    with pytest.raises(Exception, match="(?i)exist"):
        artifacts.write_bundle(spark.range(3), str(tmp_path / "bundle"))
    (tmp_path / "grades.csv").write_text("﻿item_id,verdict,notes\nG1,PASS,fine\nG2,MAYBE,x\nG2,PASS,\n", encoding="utf-8")
    faults = artifacts.grade_faults(artifacts.read_grades(spark, str(tmp_path / "grades.csv")), spark.createDataFrame([("G1",), ("G2",), ("G3",)], "item_id string"))
    assert sorted(map(tuple, faults.collect())) == [("G2", "notes"), ("G2", "repeated"), ("G2", "verdict"), ("G3", "missing")]
    (tmp_path / "docs.json").write_text(json.dumps([{"id": "a", "title": "t", "license": "l", "kind": "synthetic", "text": "x\n\ny"}]))
    assert passages.chunk(artifacts.read_documents(spark, str(tmp_path / "docs.json")), id_="id").count() == 2


def test_streaming_ingest_adds_nothing_twice(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "document_id string, text string"
    for ids in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(i, "one two\n\nthree") for i in ids], schema).write.mode("append").parquet(source)
        ingest.ingest(ingest.passages_stream(spark, source, schema), target, str(tmp_path / "checkpoint")).awaitTermination()
    rows = spark.read.parquet(target)
    assert rows.count() == rows.select("passage_id").distinct().count() == 6


def test_bootstrap_is_that_of_all_draws_at_once(monkeypatch):
    from attestor.operators import bootstrap

    values = np.array([0.5, -0.25, 0.0, 1.0, -1.0, 0.125, 0.75])
    draws = np.random.default_rng(20261013).integers(0, 7, (10_000, 7))
    expected = tuple(np.quantile(values[draws].mean(1), [0.025, 0.975]))
    assert bootstrap.interval(values, 10_000, bootstrap.SEED) == pytest.approx(expected)
    monkeypatch.setattr(bootstrap, "HELD", 1000)
    assert bootstrap.interval(values, 10_000, bootstrap.SEED) == pytest.approx(expected)


def test_containing_needles_of_all_sizes(spark):
    texts = ["the quick brown fox", "quickly browned  butter", "a\tb", "", "x", "fox\njumps over", "brown  fox", "É lan été"]
    needles = ["quick brown fox", "quick", "k b", "rown f", "brown  fox", " ", "\t", "", "  ", "x", "ox jumps", "ox\nju", "zebra", "an é", "uickly browned  butt", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame(list(enumerate(needles)), "item_id int, text string")
    found = {(r.doc_id, r.item_id) for r in retrieval.containing(docs, asked, "doc_id", "item_id").collect()}
    assert found == {(d, i) for d, t in enumerate(texts) for i, n in enumerate(needles) if n is not None and n in t}
