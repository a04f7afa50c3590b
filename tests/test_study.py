"""Answer scores, pools, contracts, settings and ledgers: exact values and what must be refused."""

import json

import pytest
from pyspark.sql import functions as F

from attestor import ledger, settings
from attestor.operators import contracts, reporting, scoring
from attestor.sources import artifacts

ANSWER = (
    "id int, expected_abstention boolean, n_required int, n_qualifications int, n_forbidden int, status string, sections array<struct<text:string,citation_ids:array<string>>>, visible array<struct<id:string,text:string>>, "
    "judgment struct<required:array<boolean>,qualifications:array<boolean>,forbidden:array<boolean>,supported:array<boolean>,citations:array<struct<section_index:int,citation_id:string,value:boolean,quotes:array<string>>>>"
)
SEEN = [("p", "The ∆t was short® and steady."), ("q", "Nothing else.")]


def row(id_, status="answered", sections=(("It was short.", ["p"]),), judgment=None, negative=False, counts=(1, 1, 1)):
    return (id_, negative, *counts, status, [(t, list(c)) for t, c in sections], SEEN, judgment)


def judged(required=(True,), qualifications=(True,), forbidden=(False,), supported=(True,), citations=((0, "p", True, ["short"]),)):
    return list(required), list(qualifications), list(forbidden), list(supported), [tuple(c) for c in citations]


def test_scores(spark):
    cases = {
        "right": row(0, judgment=judged()),
        "no judgment": row(1),
        "no answer": row(2, None, ()),
        "abstained": row(3, "insufficient_evidence", ()),
        "abstained rightly": row(4, "insufficient_evidence", (), negative=True),
        "unknown citation": row(5, sections=(("It was short.", ["z"]),), judgment=judged(citations=((0, "z", True, ["short"]),))),
        "invented quote": row(6, judgment=judged(citations=((0, "p", True, ["long"]),))),
        "false claim": row(7, judgment=judged(required=(False,))),
        "forbidden claim unknown": row(8, judgment=judged(forbidden=(None,))),
        "verbatim": row(9, sections=(("Nothing else.", ["q"]),), judgment=judged(citations=((0, "q", False, []),))),
        "incomplete": row(10, judgment=judged(required=(True, True))),
        "other citations": row(11, judgment=judged(citations=((0, "q", True, ["x"]),))),
        "blank section": row(12, sections=((" ", ["p"]),), judgment=judged(citations=((0, "p", True, ["long"]),))),
    }
    found = {n: r for n, r in zip(cases, sorted(scoring.score_answers(spark.createDataFrame(list(cases.values()), ANSWER)).collect(), key=lambda r: r.id), strict=True)}
    pick = lambda metric: {n: found[n][metric] for n in cases}
    assert pick("answer_correct") == dict.fromkeys(cases, False) | {"right": True, "verbatim": True, "no judgment": None, "abstained rightly": False, "invented quote": None, "forbidden claim unknown": None, "incomplete": None, "other citations": None}
    assert found["abstained rightly"].abstention_correct and found["abstained rightly"].negative_abstention_correct and found["abstained"].abstention_correct is False and found["no answer"].abstention_correct is False
    assert pick("citation_support") == dict.fromkeys(cases) | {"right": True, "verbatim": True, "unknown citation": None, "false claim": True, "forbidden claim unknown": True, "blank section": True}
    assert pick("citation_ids_valid") == dict.fromkeys(cases, True) | {"no answer": None, "abstained": None, "abstained rightly": None, "unknown citation": False, "blank section": False}
    assert [found["incomplete"].fault, found["other citations"].fault, found["right"].fault] == ["incomplete decisions", "citations differ", None]
    assert (found["false claim"].required_claim_coverage, found["no judgment"].required_claim_coverage, found["no answer"].required_claim_coverage) == (0, None, 0)


def test_normalized_quotes(spark):
    rows = spark.createDataFrame([row(0, judgment=judged(citations=((0, "p", True, ["Δt  was short and"]),)))], ANSWER)
    assert [scoring.score_answers(rows, n).head().citation_support for n in (False, True)] == [None, True]


def test_grading_pool_and_split(spark):
    twice = judged(citations=((0, "p", True, ["short"]), (0, "p", False, [])))
    rows = spark.createDataFrame([row(0, judgment=twice), row(1)], ANSWER).withColumns({"required_claims": F.array(F.lit("c")), "required_qualifications": F.array(F.lit("q")), "forbidden_claims": F.array(F.lit("f")), "abstention_correct": F.lit(True)})
    pool = scoring.grading_pool(rows, ["id"]).filter("id = 0").collect()
    assert sorted((r.type, r.subtype or "", r.prediction, r.raw) for r in pool) == [("abstention", "status", True, None), ("citation", "set", True, True), ("citation", "single", False, False), ("forbidden_claim", "", True, False), ("qualification", "", True, True), ("required_claim", "", True, True)]
    assert scoring.grading_pool(rows, ["id"]).filter("id = 1").count() == 1
    cases = spark.range(20).withColumnRenamed("id", "case")
    halves = {r.case: r.half for r in scoring.calibration_split(cases, "case", cases.filter("case in (3, 4)"), 5).collect()}
    assert len(halves) == 20 and sum(h == "calibration" for h in halves.values()) == 5 and halves[3] == halves[4] == "calibration"


def test_judge_input(spark):
    rows = spark.createDataFrame([row(0)], ANSWER).withColumns({"question": F.lit("Why?"), "required_claims": F.array(F.lit("c")), "required_qualifications": F.array().cast("array<string>"), "forbidden_claims": F.array().cast("array<string>")})
    given = json.loads(rows.select(scoring.judge_input(rows).alias("j")).head().j)
    assert list(given) == ["question", "required_claims", "qualifications", "forbidden_claims", "answer", "visible_passages"] and given["answer"]["status"] == "answered"


def test_reference_scores_of_two_documents(spark):
    cases = spark.createDataFrame([(1, False), (2, True)], "c int, expected_abstention boolean")
    sources = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "c int, document_id string")
    references = spark.createDataFrame([(1, "a1"), (1, "b5"), (1, "b5"), (2, "a1")], "c int, passage_id string")
    hits = spark.createDataFrame([(1, f"{'a' if i < 5 else 'b'}{i}", "a" if i < 5 else "b", i) for i in range(1, 7)], "c int, passage_id string, document_id string, rank int")
    for context, wanted in ((hits.filter("rank <= 4"), (0.5, 1.0, True, False, False, 0.5)), (hits, (0.5, 1.0, True, True, True, 1.0))):
        (r,) = reporting.reference_scores(cases, sources, references, hits, context.withColumn("place", F.col("rank")), "c").collect()
        assert (r.passage_recall_at_4, r.mrr_at_4, r.context_hit, r.complete_evidence, r.both_documents, r.context_passage_recall) == wanted and r.reference_count == 2


def test_paired_tests_leave_unknown_pairs_out(spark):
    side = lambda v: spark.createDataFrame(list(enumerate(v)), "c int, complete_evidence boolean")
    (r,) = reporting.mcnemar_pairs(side([False] * 5 + [True, None]), side([True] * 5 + [True, True]), "c", ["complete_evidence"]).collect()
    assert (r.paired_cases, r.excluded_unscored_cases, r.gains, r.losses, r.both_complete, r.p_two_sided) == (6, 1, 5, 0, 1, pytest.approx(0.0625))
    rows = spark.createDataFrame([("m", 29, 36)], "metric string, successes long, scored long")
    assert scoring.with_interval(rows).head().ci_high == pytest.approx(0.9180563608)


def test_dataset_contracts(spark, tmp_path):
    case = {
        "id": "c-1", "question": "Why?", "category": "factual", "expected_source_ids": ["a"], "references": [{"source_id": "a", "passage_id": "a:p1:w0", "paragraph": 1}], "required_claims": ["x"], "required_qualifications": [],
        "forbidden_claims": [], "expected_abstention": False, "review_status": "approved", "reviewer": "me", "review_date": "2026-01-02",
    }
    dataset = {"schema_version": 1, "id": "d", "version": "1", "split": "development", "material": "synthetic", "status": "frozen", "corpus_sha256": "a" * 64, "notes": "", "source_versions": [], "cases": [case]}

    def read(**changes):
        (tmp_path / "d.json").write_text(json.dumps(dataset | changes))
        return artifacts.read_dataset(spark, str(tmp_path / "d.json"))

    assert read()[1].count() == 1
    again = case | {"id": "c-2", "question": "why?  "}
    broken = {
        "repeated questions": {"cases": [case, again]}, "repeated cases": {"cases": [case, case | {"question": "How?"}]}, "abstention": {"cases": [case | {"expected_abstention": True}]}, "not runnable": {"corpus_sha256": None},
        "synthetic held-out": {"split": "held-out"}, "frozen without approval": {"cases": [case | {"review_status": "unreviewed", "reviewer": None, "review_date": None}]}, "unpinned sources": {"material": "real-corpus"},
        "pending corpus": {"status": "pending-real-corpus"}, "comparison of one source": {"cases": [case | {"category": "comparison"}]}, "sources without reference": {"cases": [case | {"references": []}]},
        "draft with reviewer": {"status": "draft", "cases": [case | {"review_status": "unreviewed"}]},
    }
    for fault, changes in broken.items():
        with pytest.raises(ValueError, match="contract broken"):
            read(**changes)
    (tmp_path / "d.json").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed"):
        artifacts.read_dataset(spark, str(tmp_path / "d.json"))[1].count()


def test_label_and_review_contracts(spark):
    passages = spark.createDataFrame([("p", "a", "some words")], "passage_id string, document_id string, text string")
    cases = spark.createDataFrame([("c", False, ["a"], ["x", "y"]), ("n", True, [], [])], "id string, expected_abstention boolean, expected_source_ids array<string>, required_claims array<string>")
    span = ("c", "g", "0", "p", 0, 4, "some")
    schema = "case_id string, group_id string, alternative string, passage_id string, start int, end int, quote string"
    groups = lambda rows: spark.createDataFrame(rows, "case_id string, group_id string, claim_index int")
    faults = lambda spans, g: sorted(r.fault for r in contracts.label_faults(spark.createDataFrame(spans, schema), groups(g), cases, passages).collect())
    good = [("c", "g", 0), ("c", "h", 1)]
    assert faults([span], good) == []
    assert faults([span], good[:1]) == ["claims not covered"] and faults([span], [*good, ("c", "g", 1)]) == ["repeated groups"]
    assert faults([span], [*good, ("n", "g", 0)]) == ["case without answer", "claims not covered"] and faults([span], [*good, ("z", "g", 0)]) == ["unknown case"]
    assert faults([("c", "g", "0", "p", 0, 4, "same")], good) == ["span"] and faults([("c", "g", "0", "q", 0, 4, "some")], good) == ["unknown passage"]
    assert faults([span, span], good) == ["repeated spans"] and faults([span, ("c", "g", "1", "p", 0, 4, "some")], good) == ["repeated alternatives"]
    review = spark.createDataFrame([("c", "complete", "correct", "supported", "none", [0]), ("d", "complete", "correct", "supported", "none", [])], "case_id string, status string, correctness string, citation_support string, abstention string, sections array<int>")
    results = spark.createDataFrame([("c", "answered", 2), ("d", None, 0), ("e", "answered", 0)], "case_id string, answer_status string, n_sections int")
    assert sorted((r.case_id, r.fault) for r in contracts.review_faults(review, results, "h", "h").collect()) == [("c", "sections"), ("d", "scores without answer"), ("e", "no review")]
    assert {r.fault for r in contracts.review_faults(review, results, "h", "i").collect()} >= {"other run"}


def test_study_contracts_and_merging(spark):
    cases = spark.createDataFrame([("a", False, "approved"), ("b", True, "approved")], "id string, expected_abstention boolean, review_status string")
    ranks = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("b", 1, "p")], "case_id string, rank int, passage_id string")
    assert contracts.study_faults(cases, ranks, 2, 1).count() == 0
    assert {r.fault for r in contracts.study_faults(cases, ranks.filter("rank = 2 or case_id = 'x'"), 3, 1).collect()} == {"cases", "ranking", "no ranking"}
    runs = spark.createDataFrame([("h",), ("i",), ("i",)], "sha string")
    assert sorted(r.fault for r in contracts.configuration_faults(spark.createDataFrame([("h",), ("i",), ("j",)], "sha string"), runs, "sha").collect()) == ["no run", "several runs"]
    part = lambda rows: spark.createDataFrame([(c, None, True, False) for c in rows], "case string, error string, answer_correct boolean, unscored boolean")
    expected = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "case string, ord int")
    assert [r.case for r in contracts.merged([part(["z", "x"]), part(["y"])], expected, "case", "ord").collect()] == ["x", "y", "z"]
    for parts in ([part(["x", "y"])], [part(["x", "y", "z"]), part(["z"])], [part(["x", "y", "z", "w"])]):
        with pytest.raises(ValueError, match="contract broken"):
            contracts.merged(parts, expected, "case", "ord")


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# comment\nRETRIEVAL_BACKEND='hybrid'\nHYBRID_CANDIDATES=30 # more\nANSWER_CONTEXT_CHARS=\n")
    found = settings.Settings.load(tmp_path / "env", {"HYBRID_CANDIDATES": "40"})
    assert (found.retrieval_backend, found.hybrid_candidates, found.answer_context_chars) == ("hybrid", 40, 16_000)
    for bad in ({"RETRIEVAL_BACKEND": "x"}, {"HYBRID_LEXICAL_WEIGHT": "0", "HYBRID_EMBEDDING_WEIGHT": "0"}, {"HYBRID_CANDIDATES": "many"}, {"RETRIEVAL_DIVERSITY": "0.5"}, {"RETRIEVAL_RERANKER": "minilm"}, {"ANSWER_CONTEXT_CHARS": "6999"}, {"HYBRID_LEXICAL_WEIGHT": "nan"}):
        with pytest.raises(ValueError):
            settings.Settings.load(None, bad)
    artifact = {"source": "s", "embeddings": {"encoding": {"model": "m"}}}
    digest = artifacts.canonical_hash(artifact)
    assert settings.retrieval_config_faults({"artifact_sha256": digest, "backend": "embeddings", "model": "m"}, artifact) == []
    assert settings.retrieval_config_faults({"artifact_sha256": "x", "backend": "hybrid", "model": "n"}, artifact) == ["artifact_sha256", "model"]
    assert set(settings.provenance(tmp_path)) == {"commit", "dirty", "sources_sha256"} and settings.peak_memory() > 1 << 20
    settings.frozen({"a": 1}, artifacts.canonical_hash({"a": 1}))
    with pytest.raises(ValueError):
        settings.frozen({"a": 2}, artifacts.canonical_hash({"a": 1}))


def test_ledger(tmp_path):
    prices = ledger.Prices(0.1, 0.5)
    book = ledger.Ledger(tmp_path / "l.json", 0.01, prices, patience=0.1)
    book.reserve("a", 0.006)
    for id_, amount in (("a", 0.001), ("b", 0.005), ("b", float("nan")), ("b", -1.0)):
        with pytest.raises(ValueError):
            book.reserve(id_, amount)
    book.settle("a", None, None)
    assert book.spent() == 0.006
    book.settle("a", 10_000, 2_000)
    assert book.spent() == pytest.approx(0.002) and prices.bound("é", 0) == pytest.approx(8194 * 0.1 / 1e6)
    ledger.Ledger(tmp_path / "l.json", 0.01, prices).reserve("b", 0.008)
    with pytest.raises(ValueError):
        book.settle("b", 10**6, 0)
    with pytest.raises(ValueError):
        ledger.Ledger(tmp_path / "l.json", 0.02, prices)
    (tmp_path / "l.lock").touch()
    with pytest.raises(TimeoutError):
        book.reserve("c", 0.0001)
    ledger.pinned(tmp_path / "plan", {"a": 1})
    ledger.pinned(tmp_path / "plan", {"a": 1})
    with pytest.raises(ValueError):
        ledger.pinned(tmp_path / "plan", {"a": 2})


def test_first_failure_stops_all(spark):
    assert ledger.run_all(spark.sparkContext, "fine", [lambda: spark.range(3).count(), lambda: 7]) == [3, 7]

    def fail():
        raise KeyError("stop")

    with pytest.raises(KeyError):
        ledger.run_all(spark.sparkContext, "bad", [fail, lambda: spark.range(3).count()])


def test_evidence_files(tmp_path):
    runs, reviews = [{"id": "r", "scores": [1, None]}], [{"id": "v"}]
    manifest = artifacts.write_evidence(str(tmp_path / "a.gz"), runs, reviews)
    artifacts.write_evidence(str(tmp_path / "b.gz"), runs, reviews)
    assert (tmp_path / "a.gz").read_bytes() == (tmp_path / "b.gz").read_bytes()
    assert artifacts.read_evidence(str(tmp_path / "a.gz"), manifest, lambda run: [1, None])["reviews"] == reviews
    for bad, replay in ((manifest | {"archive_sha256": "x"}, None), (manifest | {"runs": ["x"]}, None), (manifest, lambda run: [0, None])):
        with pytest.raises(ValueError):
            artifacts.read_evidence(str(tmp_path / "a.gz"), bad, replay)
    with pytest.raises(FileExistsError):
        artifacts.write_new(str(tmp_path / "a.gz"), "x")


def test_artifact_rules(spark, tmp_path):
    vectors = [[1.0, 0.0], [0.0, 1.0]]
    good = {"schema_version": 2, "source_sha256": "b" * 64, "passage_ids": ["p", "q"], "embeddings": {"encoding": {}, "passage_ids": ["p", "q"], "vectors": vectors, "vectors_sha256": artifacts.canonical_hash(vectors)}}
    assert artifacts.artifact_faults(good) == [] and artifacts.artifact_faults({"schema_version": 1, "source_sha256": "b" * 64, "passage_ids": []}) == []
    assert artifacts.artifact_faults({"schema_version": 3, "source_sha256": "b", "passage_ids": ["p", "p"]}) == ["schema_version", "source_sha256", "passage_ids"]
    assert artifacts.artifact_faults(good | {"embeddings": good["embeddings"] | {"vectors": [[1.0, 1.0], [0.0, 1.0]]}}) == ["norm", "vectors_sha256"]
    from attestor.operators import passages

    docs = spark.createDataFrame([("a", "one two three\n\nfour")], "id string, text string")
    artifacts.publish(passages.chunk(docs, 2, id_="id"), str(tmp_path / "p"))
    assert artifacts.load_passages(spark, str(tmp_path / "p"), docs, 2).count() == 3
    with pytest.raises(ValueError):
        artifacts.load_passages(spark, str(tmp_path / "p"), docs, 3)
    rows = passages.chunk(docs, 2, id_="id")
    order = ["document_id", "paragraph", "word_offset"]
    assert artifacts.passage_identity("s", {"words": 2}, rows, order) == artifacts.passage_identity("s", {"words": 2}, rows.repartition(3), order) != artifacts.passage_identity("s", {"words": 3}, rows, order)
