"""Analysis, scores, presentation, plans and the life of an index, on small fixtures with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import codec, english, present, registry, score, text
from quillon.operators import anomaly, metrics, scan, search
from quillon.plans.match import match_doc, match_text, phrase_step
from quillon.plans.query import Query
from quillon.sources import corpus, storage
from quillon.sources.index import Conflict, Index


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


DOCS = ["the quick brown fox", "a slow green turtle", "quick turtles are rare", "brown bears and quick foxes"]


def test_documents(spark):
    rows = frame(spark, "The quick brown fox, the QUICK fox!", "", None, "...", "ÉCOLE école İ ΣΑΣ 😀 e-mail").withColumn("doc", F.lit(1)).withColumn("a.b", F.lit(2))
    got = text.analyze(rows).select("a.b" if False else "`a.b`", text.canonical(F.col("doc")).alias("c"), F.col("doc.doclen").alias("n"), text.valid(F.col("doc")).alias("v")).collect()
    assert [r.c for r in got] == ["'brown':1@3 'fox':2@4,7 'quick':2@2,6 'the':2@1,5", "", None, "", "'e':1@6 'i':1@3 'mail':1@7 'école':2@1,2 'σασ':1@4 '😀':1@5"]
    assert [r.n for r in got] == [7, 0, None, 0, 7]
    assert [r.v for r in got] == [True, True, False, True, True]


def test_analysis_equals_the_model(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "cé", "d.", "e'f"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    for r in text.analyze(frame(spark, *texts)).select("text", "doc").collect():
        want = codec.analyze(r.text)
        assert [x.asDict() for x in r.doc.terms] == want["terms"] and r.doc.doclen == want["doclen"]


def test_long_text_and_many_terms(spark):
    got = text.analyze(frame(spark, " ".join(f"term{i}x" for i in range(4000)) + " end" * 30000)).select(F.size("doc.terms").alias("k"), "doc.doclen").first()
    assert tuple(got) == (4001, 34000)


@pytest.mark.parametrize(("query", "want"), [("quick & !turtle", [1, 3, 4]), ("(quick | slow) & !fox", [2, 3, 4]), ("qui*", [1, 3, 4]), ("turtle~1", [2, 3]), ("/^fox/", [1, 4]), ('"quick brown"', [1]), ("", []), ("!quick", [2]), ('"quick fo*"', [1, 4])])
def test_matching_by_every_plan(spark, query, want):
    df = frame(spark, *DOCS)
    assert ids(scan.match(df, query)) == want
    assert ids(text.analyze(df).where(match_doc(F.col("doc"), query))) == want
    index = Index.build(df, storage.scratch(spark, "t"))
    assert ids(search.match(index, query)) == want
    assert search.count(index, query).first().matches == len(want) == scan.count(df, query).first().matches


def test_random_queries_agree(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(12))) for _ in range(80)]
    df = frame(spark, *texts, None).cache()
    index = Index.build(df, storage.scratch(spark, "t"))

    def make(depth):
        kind = rng.randrange(7 if depth else 2)
        if kind < 2:
            return rng.choice(["a", "b", "c", "d", "e", "z", "/[ab]/", "a~1", "b*"])
        if kind == 2:
            return "!(" + make(depth - 1) + ")"
        if kind == 3:
            return '"' + " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 4))) + '"'
        if kind == 4:
            return f"NEAR({' '.join(rng.choice('abcde') for _ in range(rng.randrange(2, 4)))}, {rng.choice([1, 2, 5, 30])})"
        return f"({make(depth - 1)} {rng.choice('&|')} {make(depth - 1)})"

    for _ in range(12):
        q = make(3)
        want = [i for i, t in enumerate(texts, 1) if registry.matches(codec.analyze(t), Query.parse(q))]
        assert ids(scan.match(df, q)) == want, q
        assert ids(search.match(index, q)) == want, q


def test_phrase_steps(spark):
    rng = random.Random(5)
    rows = [(sorted(rng.sample(range(60), rng.randrange(8))), sorted(rng.sample(range(60), rng.randrange(8)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    for d in (1, 3, 16, 17, 40):
        got = df.select("a", "b", phrase_step(F.col("a"), F.col("b"), d).alias("x")).collect()
        assert all(r.x == [p for p in r.b if any(0 < p - y <= d for y in r.a)] for r in got), d


def test_documents_without_positions_take_phrases_for_and(spark):
    df = spark.createDataFrame([(1, "'b':1 'a':1"), (2, "'a':1 'b':1")], "doc_id int, t string")
    with pytest.raises(Exception, match="sorted"):
        df.select(codec.parsed(F.col("t"))).collect()
    assert ids(df.where("doc_id = 2").withColumn("doc", codec.parsed(F.col("t"))).where(match_doc(F.col("doc"), '"b a"'))) == [2]


def test_edits_by_bytes(spark):
    df = frame(spark, "é")
    assert ids(scan.match(df, "e~1")) == [1] and ids(scan.match(df, "e~1", by_bytes=True)) == []


def one(spark, value, *texts):
    return text.analyze(frame(spark, *texts)).select(value(F.col("doc")).alias("x")).first().x


def test_scores(spark):
    r = lambda x: round(x, 4)
    assert r(one(spark, lambda d: score.bm25(d, "quick & fox", 1000.0, 12.0), "the quick brown fox")) == 17.8840
    assert r(one(spark, lambda d: score.bm25(d, "quick", 1000.0, 12.0, [50.0]), "the quick brown fox")) == 4.1068
    assert one(spark, lambda d: score.bm25(d, "zzz", 1000.0, 12.0), "no match here") == 0
    for variant, want in (("lucene", 17.0833), ("robertson", 17.0793), ("atire", 18.1457), ("bm25+", 30.0898), ("bm25l", 18.7411)):
        assert r(one(spark, lambda d, v=variant: score.bm25(d, "quick & fox", 1000.0, 12.0, variant=v), "the quick brown fox jumps")) == want
    assert r(one(spark, lambda d: score.bm25(d, "alpha", 500.0, 8.0, k1=2.0, b=0.5), "alpha beta alpha gamma")) == 9.9620
    with pytest.raises(ValueError, match='unknown bm25 variant "bogus"'):
        score.idf(1.0, 1.0, "bogus")
    two = text.analyze(text.analyze(spark.createDataFrame([("quick fox", "the quick brown fox runs fast")], "t string, b string"), "t", "t"), "b", "b")
    assert r(two.select(score.bm25f([F.col("t"), F.col("b")], "quick & fox", [2.0, 1.0], 1000.0, [3.0, 10.0]).alias("x")).first().x) == 22.1299
    assert one(spark, lambda d: score.bm25(d, "a", None, 1.0), "a") is None and one(spark, lambda d: score.bm25(d, "a", 5.0, 0.0, [None]), "a") > 0
    twice = one(spark, lambda d: score.bm25(d, "fox fox", 10.0, 4.0), "fox") / one(spark, lambda d: score.bm25(d, "fox", 10.0, 4.0), "fox")
    assert abs(twice - 2) < 1e-12


def test_top_k(spark):
    df = frame(spark, "quick quick quick fox", "quick brown fox", "a slow turtle", "quick")
    index = Index.build(df, storage.scratch(spark, "t"))
    for rows in (search.search(index, "quick").collect(), scan.search(df, "quick").collect()):
        assert [(r.doc_id, round(r.score, 3)) for r in rows] == [(1, 0.511), (4, 0.482), (2, 0.344)]
    assert [r.doc_id for r in search.ordered(index, "quick", 2).collect()] == [1, 4]
    assert len(search.search(index, "quick", -3).collect()) == 1
    assert search.search(index, "!quick").collect() == [] and search.search(index, "").collect() == []


def test_patterns_rank_only_by_their_literal(spark):
    index = Index.build(frame(spark, "document", "documemt", "doc", "zulu document"), storage.scratch(spark, "t"))
    assert ids(search.match(index, "document~1")) == [1, 2, 4] and ids(search.search(index, "document~1")) == [1, 4]


def test_highlight_and_snippet(spark):
    def of(t, f):
        return frame(spark, t).select(f(F.col("text")).alias("x")).first().x

    assert of("The quick brown fox jumped", lambda t: present.highlight(t, "quick | fox", "[", "]")) == "The [quick] brown [fox] jumped"
    assert of("nothing here matches", lambda t: present.highlight(t, "zebra", "[", "]")) == "nothing here matches"
    assert of(None, lambda t: present.highlight(t, "zebra")) is None
    long = "lorem ipsum dolor the quick brown fox jumps over the lazy dog etcetera etc"
    assert of(long, lambda t: present.snippet(t, "quick & fox", "<", ">", "...", 6)) == "...ipsum dolor the <quick> brown <fox>..."
    needle = "alpha beta gamma delta " * 20 + "needle tail"
    assert of(needle, lambda t: present.snippet(t, "needle")) == "...gamma delta alpha beta gamma delta alpha beta gamma delta alpha beta gamma delta <b>needle</b>..."
    assert of("short doc with needle", lambda t: present.snippet(t, "needle", "<<", ">>", " ... ", 5)) == "short doc with <<needle>>"
    assert of("the quick brown fox", lambda t: present.snippet(t, '"quick brown"')) == "the <b>quick</b> <b>brown</b> fox"
    assert of("", lambda t: present.snippet(t, "a")) == "" and of(None, lambda t: present.snippet(t, "a")) is None
    assert of("a b c", lambda t: present.snippet(t, "b", "[", "]", "…", 0)) == "…[b]…"


def test_rare_terms(spark):
    boiler = ["the common ordinary boilerplate text"] * 50
    df = frame(spark, *boiler, "the zzq", "the zzr zza", "the zzq zzs")
    index = Index.build(df, storage.scratch(spark, "t"))
    for f in (lambda k, m: anomaly.anomalous(index, k, m), lambda k, m: anomaly.anomalous_scan(df, k, m)):
        got = f(10, 1).collect()
        assert [(r.doc_id, r.rarest_term, r.min_df) for r in got] == [(52, "zza", 1), (53, "zzs", 1)]
        assert ids(f(10, None)) == [52, 53] and ids(f(10, 2)) == [51, 52, 53] and f(10, 0).collect() == []
        with pytest.raises(ValueError, match="k must be"):
            f(0, None)
    assert math.isclose(got[0].score, math.log(1 + 52.5 / 1.5))


def test_life_of_an_index(spark):
    path = storage.scratch(spark, "t")
    empty = Index.create(spark, path, buckets=4, shards=2)
    with pytest.raises(Conflict):
        Index.create(spark, path)
    assert search.match(empty, "a").collect() == [] and search.stats(empty).first().ndocs == 0 and anomaly.anomalous(empty).collect() == []
    index = empty.insert(frame(spark, "alpha beta", "alpha", None, ""))
    assert ids(search.match(index, "alpha")) == [1, 2] and ids(search.match(index, "!beta")) == [2, 4]
    assert ids(search.search(index, "alpha", pending=False)) == [] and ids(search.search(index, "alpha")) == [1, 2]
    index = index.flush()
    assert index.segments() == 1 and index.flush() is index
    more = spark.createDataFrame([(10, "alpha gamma"), (11, "delta")], "doc_id bigint, text string")
    index = index.insert(more).flush()
    assert index.segments() == 2 and search.count(index, "alpha").first().matches == 3
    gone = index.delete(spark.createDataFrame([(2,)], "doc_id bigint"))
    assert ids(search.match(gone, "alpha")) == [1, 10] and search.count(gone, "alpha").first().matches == 2
    assert [r.df for r in search.document_frequencies(gone, "alpha & nothing | alpha").orderBy("position").collect()] == [2.0, 1.0, 2.0]
    back = gone.insert(spark.createDataFrame([(2, "alpha again")], "doc_id bigint, text string"))
    assert ids(search.match(back, "alpha")) == [1, 2, 10]
    with pytest.raises(Conflict):
        gone.insert(more)  # an old state
    one_, done = back.merge()
    assert done and one_.segments() == 1 and not one_.merge()[1]
    assert ids(search.match(one_, "alpha")) == [1, 2, 10] and search.stats(one_).first().ndocs == 5
    small, done = one_.vacuum()
    assert done and not small.vacuum()[1] and ids(search.match(Index.open(spark, path), "alpha")) == [1, 2, 10]
    assert ids(search.match(small.reindex(more), "alpha")) == [10]
    again = Index.open(spark, path).insert(more, name="batch-1")
    assert again.insert(more, name="batch-1") is again
    storage.write_json(spark, f"{path}/manifests/00000099.json", {"format": 7})
    with pytest.raises(ValueError, match="format 7"):
        Index.open(spark, path)


def test_tiered_merging(spark):
    index = Index.create(spark, storage.scratch(spark, "t"), buckets=2)
    for k in range(4):
        index = index.insert(spark.createDataFrame([(k, f"common t{k}")], "doc_id bigint, text string")).flush()
    assert index.compact(least=5) is index
    index = index.compact()
    assert index.segments() == 1 and ids(search.match(index, "common")) == [0, 1, 2, 3]


def test_configurations(spark):
    def of(config, t):
        return english.analyze_config(frame(spark, t), config).select(text.canonical(F.col("doc")).alias("c"), "doc.doclen").first()

    assert tuple(of("english", "running the races quickly")) == ("'quick':1@4 'race':1@3 'run':1@1", 4)
    assert of("english", "the cat and a dog").c == "'cat':1@2 'dog':1@5"
    assert of("simple", "The Quick").c == "'quick':1@2 'the':1@1" and of("english", None).c is None
    for word, want in (("relational", "relat"), ("conditional", "condit"), ("hopping", "hop"), ("hoping", "hope"), ("flies", "fli"), ("generalization", "general"), ("happily", "happili"), ("skies", "sky"), ("agreed", "agre"), ("consistency", "consist"), ("knitting", "knit"), ("kneeled", "kneel"), ("sensational", "sensat"), ("national", "nation"), ("possibly", "possibl")):
        assert english.stem(word) == want, word
    df = frame(spark, "she runs races", "a running race")
    docs = english.analyze_config(df, "english")
    assert ids(docs.where(match_doc(F.col("doc"), english.parse_query("english", "runs & racing")))) == [1, 2]
    assert ids(docs.where(match_doc(F.col("doc"), english.parse_query("english", "the & race")))) == []
    with pytest.raises(ValueError, match="does not exist"):
        english.parse_query("klingon", "a")


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, 3.0), ("q", 2, 2.0), ("q", 3, 1.0)], "query_id string, doc_id bigint, score double")
    judged = spark.createDataFrame([("q", 2, 1), ("q", 9, 1)], "query_id string, doc_id bigint, relevance int")
    r = metrics.evaluate(ranked, judged).first()
    assert (round(r.ndcg, 6), r.recall, r.mrr) == (round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6), 0.5, 0.5)


def test_corpora(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"x, y ""z"""\n2,\n')
    (tmp_path / "a.tsv").write_text("1\tx y\n")
    got = corpus.read_csv(spark, str(tmp_path / "a.csv"), "id bigint, body string").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 'x, y "z"'), (2, None)]
    assert corpus.read_tsv(spark, str(tmp_path / "a.tsv"), "id bigint, body string").first().text == "x y"


def test_filters_reach_the_files(spark):
    index = Index.build(frame(spark, *DOCS), storage.scratch(spark, "t"))
    plan = search.search(index, "quick")._jdf.queryExecution().executedPlan().toString()
    assert "(bucket#" in plan.split("PartitionFilters")[1] and "PushedFilters: [IsNotNull(term), EqualTo(term,quick)]" in plan and "positions" not in plan
    assert "doclen:int>" in plan and plan.count("Exchange hashpartitioning") == 1  # the one by document
    assert match_text  # the scan's predicate is public
