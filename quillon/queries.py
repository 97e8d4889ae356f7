"""The catalogue: a query for each operator over whole tables, and the same in DuckDB's SQL.

Queries named index_* go through an index built for them in the shared folder; the others
read the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec, english, present, score, text
from .operators import anomaly, metrics, scan, search
from .plans.match import match_doc
from .plans.query import Query
from .sources import storage
from .sources.index import Index
from .streaming import ingest

TOKEN = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *(columns or ("text",)))


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = " ".join(sql.split()) if "\n" in sql else sql


# --- parts of the oracles

_T = f"t AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM documents)"
_P = f"{_T}, p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM t)"
_F = f"{_P}, f AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), l AS (SELECT doc_id, len(w) AS doclen FROM t), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(doclen) AS avgdl FROM l), d AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM f GROUP BY term)"
has = lambda x: f"list_contains(w, '{x}')"
any_of = lambda c: f"len(list_filter(w, lambda x: {c})) > 0"
_IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
_TF = "tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doclen / avgdl))"


def _near(a: str, b: str, gap: int) -> str:
    return f"SELECT DISTINCT x.doc_id FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.pos > x.pos AND y.pos - x.pos <= {gap} WHERE x.term = '{a}' AND y.term = '{b}'"


# --- analysis


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.analyze(_docs(spark, sf_dir), keep_text=False)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyzed(spark, sf_dir).select("doc_id", F.explode("doc.terms").alias("t")).select("doc_id", "t.term", "t.tf", "t.pos")


_add("tokenize_tf", lambda s, d: _terms(s, d).select("doc_id", "term", F.col("tf").cast("bigint").alias("tf")), f"WITH {_P} SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL")
_add("term_positions", lambda s, d: _terms(s, d).select("doc_id", "term", F.array_join(F.transform("pos", lambda p: p.cast("string")), ",").alias("positions")), f"WITH {_P} SELECT doc_id, term, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY ALL")
_add("doc_length", lambda s, d: _analyzed(s, d).select("doc_id", text.doc_length(F.col("doc")).cast("bigint").alias("doclen")), f"WITH {_T} SELECT doc_id, len(w) AS doclen FROM t")
_add(
    "doc_canonical_text",
    lambda s, d: _analyzed(s, d).select("doc_id", text.canonical(F.col("doc")).alias("canonical")),
    f"WITH {_P}, g AS (SELECT doc_id, term, '''' || term || ''':' || count(*) || '@' || string_agg(pos::VARCHAR, ',' ORDER BY pos) AS e FROM p GROUP BY doc_id, term), c AS (SELECT doc_id, string_agg(e, ' ' ORDER BY term) AS canonical FROM g GROUP BY doc_id) SELECT t.doc_id, coalesce(canonical, '') AS canonical FROM t LEFT JOIN c USING (doc_id)",
)
_add("doc_valid", lambda s, d: _analyzed(s, d).select("doc_id", text.valid(F.col("doc")).alias("valid")), "SELECT doc_id, true AS valid FROM documents")
_add("doc_lookup", lambda s, d: _analyzed(s, d).select("doc_id", text.term_frequency(F.col("doc"), "the").cast("bigint").alias("tf")), f"WITH {_T} SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS tf FROM t")
_add(
    "doc_round_trips",
    lambda s, d: _analyzed(s, d).select("doc_id", codec.received(codec.sent(F.col("doc"))).eqNullSafe(F.col("doc")).alias("bytes_same"), codec.parsed(text.canonical(F.col("doc"))).eqNullSafe(F.col("doc")).alias("text_same")),
    "SELECT doc_id, true AS bytes_same, true AS text_same FROM documents",
)
_add("english_stems", lambda s, d: english.analyze_config(_docs(s, d), "english", keep_text=False).select("doc_id", text.canonical(F.col("doc")).alias("canonical"), F.col("doc.doclen").alias("doclen")))
_add("english_stem_match", lambda s, d: english.analyze_config(_docs(s, d), "english", keep_text=False).where(match_doc(F.col("doc"), english.parse_query("english", "tions | entes"))).select("doc_id"))


def _tsvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    vector = F.array_join(F.transform(F.array_distinct(text.tokens(F.col("text"))), lambda t: F.concat(F.lit("'"), t, F.lit("':1A"))), " ")
    return docs.select("doc_id", codec.tsvector(vector).alias("doc")).select("doc_id", F.size("doc.terms").cast("bigint").alias("terms"), F.col("doc.doclen").cast("bigint").alias("doclen"))


_add("doc_from_tsvector", _tsvector, f"WITH {_T} SELECT doc_id, len(list_distinct(w)) AS terms, len(list_distinct(w)) AS doclen FROM t")

# --- matching

_MATCH = {
    "term": ("the", has("the")),
    "and": ("the & of", f"{has('the')} AND {has('of')}"),
    "or": ("der | les | que", f"{has('der')} OR {has('les')} OR {has('que')}"),
    "not": ("the & !of", f"{has('the')} AND NOT {has('of')}"),
    "pure_not": ("!the", f"NOT {has('the')}"),
    "nested": ("(the | der) and not (of or que) in", f"({has('the')} OR {has('der')}) AND NOT ({has('of')} OR {has('que')}) AND {has('in')}"),
    "prefix": ("tion*", any_of("x LIKE 'tion%'")),
    "regex": ("/^tion.*s$/", any_of("regexp_matches(x, '^tion.*s$')")),
    "fuzzy": ("that~1", any_of("levenshtein(x, 'that') <= 1")),
    "mixed": ("(tion* | that~1) & !les", f"({any_of(chr(120) + ' LIKE ' + chr(39) + 'tion%' + chr(39))} OR {any_of('levenshtein(x, ' + chr(39) + 'that' + chr(39) + ') <= 1')}) AND NOT {has('les')}"),
}
_PLACED = {
    "phrase2": ('"of the"', _near("of", "the", 1)),
    "phrase3": ('"in of the"', "SELECT DISTINCT x.doc_id FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 JOIN p z ON x.doc_id = z.doc_id AND z.pos = y.pos + 1 WHERE x.term = 'in' AND y.term = 'of' AND z.term = 'the'"),
    "near2": ("NEAR(of the, 3)", _near("of", "the", 3)),
    "near2_wide": ("NEAR(the of, 40)", _near("the", "of", 40)),
    # the right pair first; what it ends on must follow the left term
    "near3": ("NEAR(the of in, 4)", "SELECT DISTINCT x.doc_id FROM p x JOIN (SELECT DISTINCT z.doc_id, z.pos FROM p y JOIN p z ON y.doc_id = z.doc_id AND z.pos > y.pos AND z.pos - y.pos <= 4 WHERE y.term = 'of' AND z.term = 'in') r ON x.doc_id = r.doc_id AND r.pos > x.pos AND r.pos - x.pos <= 4 WHERE x.term = 'the'"),
    "phrase_and_not": ('"of the" & !der', f"SELECT doc_id FROM ({_near('of', 'the', 1)}) WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'der')"),
}
_SQL = {n: (q, f"WITH {_T} SELECT doc_id FROM t WHERE {c}") for n, (q, c) in _MATCH.items()} | {n: (q, f"WITH {_P} {c}") for n, (q, c) in _PLACED.items()}


def _index(spark: SparkSession, sf_dir: str, **options) -> Index:
    return Index.build(_docs(spark, sf_dir), storage.scratch(spark, "index"), **options)


for _n, (_q, _s) in _SQL.items():
    _add(f"match_{_n}", lambda s, d, q=_q: scan.match(_docs(s, d), q).select("doc_id"), _s)
    _add(f"count_{_n}", lambda s, d, q=_q: scan.count(_docs(s, d), q), f"SELECT count(*) AS matches FROM ({_s})")
    _add(f"match_doc_{_n}", lambda s, d, q=_q: _analyzed(s, d).where(match_doc(F.col("doc"), q)).select("doc_id"), _s)


def _index_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, out = _index(spark, sf_dir), None
    for n, (q, _) in _SQL.items():
        one = search.match(index, q).select(F.lit(n).alias("query"), "doc_id")
        out = one if out is None else out.unionAll(one)
    return out


def _index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, out = _index(spark, sf_dir), None
    for n, (q, _) in _SQL.items():
        one = search.count(index, q).select(F.lit(n).alias("query"), "matches")
        out = one if out is None else out.unionAll(one)
    return out


_add("index_match", _index_matches, " UNION ALL ".join(f"SELECT '{n}' AS query, doc_id FROM ({s})" for n, (_, s) in _SQL.items()))
_add("index_count", _index_counts, " UNION ALL ".join(f"SELECT '{n}' AS query, count(*) AS matches FROM ({s})" for n, (_, s) in _SQL.items()))


def _unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match(_index(spark, sf_dir, positions=False), '"of the"', texts=_docs(spark, sf_dir))


_add("index_phrase_without_positions", _unplaced, f"WITH {_P} {_near('of', 'the', 1)}")
_add("match_tsquery", lambda s, d: scan.match(_docs(s, d), Query.from_tsquery("'of' <2> 'the' & !'der'")).select("doc_id"), f"WITH {_P} SELECT doc_id FROM ({_near('of', 'the', 2)}) WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'der')")
_add("query_texts", lambda s, d: s.createDataFrame([(n, str(Query.parse(q)), str(Query.from_bytes(Query.parse(q).to_bytes()))) for n, (q, _) in _SQL.items()], "query string, canonical string, round_trip string"))

# --- scores

_SCORED = "the & of | tion"
_W = [("the", 5875.0), ("of", 5610.0), ("tion", 12.0)]


def _scalar_sql(variant: str) -> str:
    n, avgdl, out = 10000.0, 395.0, []
    for t, df in _W:
        idf = {"robertson": f"ln(({n} - {df} + 0.5) / ({df} + 0.5))", "atire": f"ln({n} / {df})", "bm25l": f"ln(({n} + 1) / ({df} + 0.5))"}.get(variant, f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5))")
        tf, length = f"len(list_filter(w, lambda x: x = '{t}'))", f"(1 - 0.75 + 0.75 * len(w) / {avgdl})"
        part = f"{tf} * 2.2 / ({tf} + 1.2 * {length})"
        if variant == "bm25l":
            part = f"2.2 * ({tf} / {length} + 0.5) / (1.2 + {tf} / {length} + 0.5)"
        elif variant == "bm25+":
            part = f"({part} + 1)"
        out.append(f"CASE WHEN {tf} > 0 THEN {idf} * {part} ELSE 0 END")
    return f"WITH {_T} SELECT doc_id, round({' + '.join(out)}, 6) AS score FROM t"


for _v, _k in (("lucene", "lucene"), ("robertson", "robertson"), ("atire", "atire"), ("bm25+", "bm25plus"), ("bm25l", "bm25l")):
    _add(f"bm25_scalar_{_k}", lambda s, d, v=_v: _analyzed(s, d).select("doc_id", F.round(score.bm25(F.col("doc"), _SCORED, 10000.0, 395.0, [x for _, x in _W], variant=v), 6).alias("score")), _scalar_sql(_v))


def _two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.analyze(text.analyze(_docs(spark, sf_dir, "source", "text"), "source", "title"), "text", "body")
    return rows.select("doc_id", F.round(score.bm25f([F.col("title"), F.col("body")], "src1 | the", [2.0, 1.0], 1000.0, [1.0, 395.0], [40.0, 615.0]), 6).alias("score"))


def _fields_sql() -> str:
    out = []
    for t, df in (("src1", 40.0), ("the", 615.0)):
        tf = f"(2.0 * len(list_filter(v, lambda x: x = '{t}')) / (1 - 0.75 + 0.75 * len(v) / 1.0) + len(list_filter(w, lambda x: x = '{t}')) / (1 - 0.75 + 0.75 * len(w) / 395.0))"
        out.append(f"CASE WHEN {tf} > 0 THEN ln(1 + (1000.0 - {df} + 0.5) / ({df} + 0.5)) * {tf} * 2.2 / (1.2 + {tf}) ELSE 0 END")
    return f"WITH u AS (SELECT doc_id, regexp_extract_all(lower(source), '{TOKEN}') AS v, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM documents) SELECT doc_id, round({' + '.join(out)}, 6) AS score FROM u"


_add("bm25f_two_field", _two_fields, _fields_sql())
_add(
    "distance_fallback",
    lambda s, d: _analyzed(s, d).select("doc_id", F.round(score.distance_fallback(F.col("doc"), "the & of"), 6).alias("distance")),
    f"WITH {_T}, x AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'of')) AS b FROM t) SELECT doc_id, round(1 / (1 + ln(4 / 3) * (a * 2.2 / (a + 1.2) + b * 2.2 / (b + 1.2))), 6) AS distance FROM x",
)
_add("order_by_fallback", lambda s, d: _analyzed(s, d).select("doc_id", F.round(score.distance_fallback(F.col("doc"), "the"), 6).alias("distance")).orderBy("distance", "doc_id").limit(20), f"WITH {_T}, x AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS a FROM t) SELECT doc_id, round(1 / (1 + ln(4 / 3) * a * 2.2 / (a + 1.2)), 6) AS distance FROM x ORDER BY distance, doc_id LIMIT 20")

# --- top k


def _ranked_sql(terms: dict[str, int], where: str = "true", k: int = 10, value: str = "round(score, 6) AS score") -> str:
    weight = "CASE term " + " ".join(f"WHEN '{t}' THEN {m}" for t, m in terms.items()) + " END"
    inside = ", ".join(f"'{t}'" for t in terms)
    return f"WITH {_F}, c AS (SELECT doc_id, sum({weight} * {_IDF} * {_TF}) AS score FROM f JOIN d USING (term) JOIN l USING (doc_id) CROSS JOIN s WHERE term IN ({inside}) GROUP BY doc_id), r AS (SELECT doc_id, round(score, 9) AS score FROM c JOIN t USING (doc_id) WHERE {where}) SELECT doc_id, {value} FROM r ORDER BY r.score DESC, doc_id LIMIT {k}"


_TOP = {
    "term": ("tion", {"tion": 1}, "true"),
    "or": ("tion | ation | enea", {"tion": 1, "ation": 1, "enea": 1}, "true"),
    "and": ("the & of", {"the": 1, "of": 1}, f"{has('the')} AND {has('of')}"),
    "not": ("the & !of", {"the": 1, "of": 1}, f"{has('the')} AND NOT {has('of')}"),
    "dup_term": ("the the of", {"the": 2, "of": 1}, f"{has('the')} AND {has('of')}"),
    "phrase": ('"of the"', {"of": 1, "the": 1}, f"t.doc_id IN ({_near('of', 'the', 1)})"),
    "prefix": ("tion* | the", {"tion": 1, "the": 1}, "true"),
}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


def _steady(ranked: DataFrame, k: int = 10) -> DataFrame:
    """The top k by scores whose last digits, which hang on the order of summing, are cut off: equal documents tie in any engine."""
    return _rounded(ranked.select("doc_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k))


for _n, (_q, _t, _c) in _TOP.items():
    _add(f"search_topk_{_n}", lambda s, d, q=_q: _steady(scan.scored(_docs(s, d), q).where("matches and hits > 0").select("doc_id", "score")), _ranked_sql(_t, _c))


def _index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.postings import ranked

    index, out = _index(spark, sf_dir), None
    for n, (q, _, _) in _TOP.items():
        one = _steady(ranked(index, q)).select(F.lit(n).alias("query"), "doc_id", "score")
        out = one if out is None else out.unionAll(one)
    return out


_add("index_topk", _index_topk, " UNION ALL ".join(f"SELECT '{n}' AS query, doc_id, score FROM ({_ranked_sql(t, c)})" for n, (_, t, c) in _TOP.items()))
_add("index_order_by_distance", lambda s, d: search.ordered(_index(s, d), "the & of").select("doc_id", F.round("distance", 6).alias("distance")), _ranked_sql({"the": 1, "of": 1}, f"{has('the')} AND {has('of')}", 1 << 60, "round(1 / (1 + r.score), 6) AS distance"))


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "text", "lang")
    ranked = None
    for q, lang in (("the | of", "en"), ("der | und", "de"), ("les | des", "fr")):
        one = scan.scored(docs, q).where("hits > 0").select(F.lit(lang).alias("query_id"), "doc_id", F.round("score", 9).alias("score"))
        ranked = one if ranked is None else ranked.unionAll(one)
    judged = docs.where(F.col("lang").isin("en", "de", "fr")).select(F.col("lang").alias("query_id"), "doc_id", F.lit(1).alias("relevance"))
    return metrics.evaluate(ranked, judged).select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")])


def _relevance_sql() -> str:
    parts = []
    for terms, lang in ((("the", "of"), "en"), (("der", "und"), "de"), (("les", "des"), "fr")):
        inside = ", ".join(f"'{t}'" for t in terms)
        parts.append(f"SELECT '{lang}' AS query_id, doc_id, round(sum({_IDF} * {_TF}), 9) AS score FROM f JOIN d USING (term) JOIN l USING (doc_id) CROSS JOIN s WHERE term IN ({inside}) GROUP BY doc_id")
    return (
        f"WITH {_F}, q AS ({' UNION ALL '.join(parts)}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM q), g AS (SELECT k.*, (documents.lang = query_id)::INT AS rel FROM k JOIN documents USING (doc_id)), "
        "h AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 100 THEN rel ELSE 0 END) AS hits, min(CASE WHEN rel > 0 THEN rank END) AS first FROM g GROUP BY query_id), "
        "m AS (SELECT lang AS query_id, count(*) AS many FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY lang), i AS (SELECT query_id, many, (SELECT sum(1 / log2(r + 1)) FROM range(1, 11) x(r) WHERE r <= many) AS ideal FROM m) "
        "SELECT query_id, round(dcg / ideal, 6) AS ndcg, round(hits / many, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr FROM h JOIN i USING (query_id)"
    )


_add("relevance_metrics", _relevance, _relevance_sql())

# --- statistics

_add("corpus_stats", lambda s, d: search.stats(_index(s, d)).select("ndocs", F.round("avgdl", 6).alias("avgdl"), "nterms"), f"WITH {_F} SELECT n AS ndocs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM d) AS nterms FROM s")
_add("dictionary", lambda s, d: _index(s, d).dictionary().select("term", "df", F.col("max_tf").cast("bigint").alias("max_tf")), f"WITH {_F} SELECT term, count(*) AS df, max(tf) AS max_tf FROM f GROUP BY term")
_add("term_df_topn", lambda s, d: _index(s, d).dictionary().select("term", "df").orderBy(F.desc("df"), "term").limit(50), f"WITH {_F} SELECT term, CAST(df AS BIGINT) AS df FROM d ORDER BY df DESC, term LIMIT 50")
_add("index_df", lambda s, d: search.document_frequencies(_index(s, d), "the & !the | nosuchterm & tion*"), f"WITH {_F}, v(position, term) AS (VALUES (0, 'the'), (1, 'the'), (2, 'nosuchterm'), (3, 'tion')) SELECT position, term, CAST(greatest(coalesce(df, 0), 1) AS DOUBLE) AS df FROM v LEFT JOIN d USING (term)")
_add("facet_counts", lambda s, d: scan.match(_docs(s, d, "text", "lang", "source"), "the | les").groupBy("lang").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("source").alias("sources")), f"WITH {_T} SELECT lang, count(*) AS matches, count(DISTINCT source) AS sources FROM documents JOIN t USING (doc_id) WHERE {has('the')} OR {has('les')} GROUP BY lang")

for _n, _m in (("default", None), ("one", 1), ("five", 5)):
    _limit = "greatest(floor(n / 1000), 1)" if _m is None else str(_m)
    _add(
        f"anomalous_docs_{_n}",
        lambda s, d, m=_m: _anomalies(anomaly.anomalous_scan(_docs(s, d), None, m)),
        f"WITH {_F}, z AS (SELECT doc_id, min(ROW(df, term)) AS r, min(n) AS n FROM f JOIN d USING (term) CROSS JOIN s WHERE df <= {_limit} GROUP BY doc_id) SELECT doc_id, round(ln(1 + (n - r[1] + 0.5) / (r[1] + 0.5)), 6) AS score, r[2] AS rarest_term, CAST(r[1] AS BIGINT) AS min_df FROM z",
    )


def _anomalies(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"), "rarest_term", "min_df")


_add("index_anomalous_top", lambda s, d: _anomalies(anomaly.anomalous(_index(s, d), 25, 5)), f"SELECT * FROM ({ORACLE['anomalous_docs_five']}) ORDER BY score DESC, doc_id LIMIT 25")

# --- presentation

_PART = f"regexp_extract_all(text, '{TOKEN}|[^A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
_add("highlight", lambda s, d: _docs(s, d).select("doc_id", present.highlight(F.col("text"), "the & of | !que | tion*").alias("marked")), f"SELECT doc_id, array_to_string(list_transform({_PART}, lambda x: CASE WHEN lower(x) IN ('the', 'of', 'que', 'tion') THEN '<b>' || x || '</b>' ELSE x END), '') AS marked FROM documents")
_add(
    "snippet",
    lambda s, d: _docs(s, d).select("doc_id", present.snippet(F.col("text"), "the & of | que", "[", "]", "...", 8).alias("snippet")),
    f"WITH u AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS v FROM documents), h AS (SELECT doc_id, v, list_transform(v, lambda x: (lower(x) IN ('the', 'of', 'que'))::INT) AS hit FROM u), "
    "o AS (SELECT doc_id, v, hit, unnest(generate_series(0, greatest(len(v) - 8, 0))) AS s FROM h), b AS (SELECT doc_id, any_value(v) AS v, max(ROW(list_sum(hit[s + 1 : s + 8]), -s)) AS best FROM o GROUP BY doc_id) "
    "SELECT doc_id, (CASE WHEN best[2] < 0 THEN '...' ELSE '' END) || coalesce(array_to_string(list_transform(v[1 - best[2] : 8 - best[2]], lambda x: CASE WHEN lower(x) IN ('the', 'of', 'que') THEN '[' || x || ']' ELSE x END), ' '), '') || (CASE WHEN 8 - best[2] < len(v) THEN '...' ELSE '' END) AS snippet FROM b",
)

# --- the life of an index

_LIFE = "the & of"
_FILE_BYTES = 1 << 25


def _parts(spark: SparkSession, sf_dir: str) -> tuple[Index, DataFrame]:
    """An index of three segments by source, and the documents."""
    docs = _docs(spark, sf_dir, "text", "source")
    index = Index.create(spark, storage.scratch(spark, "index"))
    for k in range(3):
        index = index.insert(docs.where(F.pmod(F.col("doc_id"), F.lit(3)) == k)).flush()
    return index, docs


def _topk(index: Index, **options) -> DataFrame:
    from .plans.postings import ranked

    return _steady(ranked(index, _LIFE, **options), 20)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _parts(spark, sf_dir)
    return _topk(index.merge()[0])


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(_parts(spark, sf_dir)[0])


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _parts(spark, sf_dir)[0].compact(least=3)
    return search.stats(index).select("ndocs", F.round("avgdl", 6).alias("avgdl"), "nterms", F.lit(index.segments()).alias("segments"))


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, docs = _parts(spark, sf_dir)
    return _topk(index.delete(docs.where("source = 'src1'")))


def _vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, docs = _parts(spark, sf_dir)
    return _topk(index.delete(docs.where("source = 'src1'")).vacuum()[0])


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    half = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    index = Index.build(docs.where(half), storage.scratch(spark, "index")).insert(docs.where(~half))
    return search.match(index, _LIFE)


def _reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return _topk(Index.build(docs.where("doc_id < 0"), storage.scratch(spark, "index")).insert(docs).delete(docs).reindex(docs))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream into an index: three batches, each of as many files as there are _FILE_BYTES in a third of the documents."""
    files, path = storage.scratch(spark, "files"), storage.scratch(spark, "index")
    each = math.ceil(storage.size(spark, f"{sf_dir}/documents.parquet") / (3 * _FILE_BYTES))
    _docs(spark, sf_dir).repartition(3 * each).write.parquet(files)
    Index.create(spark, path)
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", each).parquet(files)
    ingest.ingest(stream, path, storage.scratch(spark, "progress"), flush_every=2).awaitTermination()
    return _topk(Index.open(spark, path))


_ALL = _ranked_sql({"the": 1, "of": 1}, f"{has('the')} AND {has('of')}", 20)
_REST = _ALL.replace("FROM documents)", "FROM documents WHERE source != 'src1')")
_add("index_merge_equivalence", _merged, _ALL)
_add("index_three_segments", _segmented, _ALL)
_add("index_tiered_merge", _compacted, ORACLE["corpus_stats"].replace(" FROM s", ", 1 AS segments FROM s"))
_add("index_delete_tombstones", _deleted, _REST)
_add("index_vacuum", _vacuumed, _REST)
_add("index_pending_visibility", _pending, _SQL["and"][1])
_add("index_reindex", _reindexed, _ALL)
_add("stream_ingest", _streamed, _ALL)


def _sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.registry import register

    register(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("quillon_documents")
    return spark.sql("SELECT doc_id, fts_match(to_ftsdoc(text), 'the & !of') AS matches, ftsdoc_length(to_ftsdoc(text)) AS doclen FROM quillon_documents")


_add("sql_functions", _sql_functions, f"WITH {_T} SELECT doc_id, {has('the')} AND NOT {has('of')} AS matches, CAST(len(w) AS INTEGER) AS doclen FROM t")


#: The canonical texts of the catalogue's queries, written down by hand.
_GOLDEN = {
    "term": "'the'",
    "and": "('the' & 'of')",
    "or": "(('der' | 'les') | 'que')",
    "not": "('the' & !'of')",
    "pure_not": "!'the'",
    "nested": "((('the' | 'der') & !('of' | 'que')) & 'in')",
    "prefix": "'tion'*",
    "regex": "/^tion.*s$/",
    "fuzzy": "'that'~1",
    "mixed": "(('tion'* | 'that'~1) & !'les')",
    "phrase2": "('of' <-> 'the')",
    "phrase3": "(('in' <-> 'of') <-> 'the')",
    "near2": "('of' <-> 'the')",
    "near2_wide": "('the' <-> 'of')",
    "near3": "('the' <-> ('of' <-> 'in'))",
    "phrase_and_not": "(('of' <-> 'the') & !'der')",
}


def _sql(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .functions.registry import register

        register(spark)
        _docs(spark, sf_dir).createOrReplaceTempView("quillon_documents")
        return spark.sql(query)

    return run


_add("sql_snippet", _sql("SELECT doc_id, fts_snippet(text, 'the & of | que', '[', ']', '...', 8) AS snippet FROM quillon_documents"), ORACLE["snippet"])
_add("sql_regex", _sql(r"SELECT doc_id FROM quillon_documents WHERE fts_match(to_ftsdoc(text), r'/\mtion[[:lower:]]*s\M/')"), f"WITH {_T} SELECT doc_id FROM t WHERE {any_of(chr(114) + 'egexp_matches(x, ' + chr(39) + '^tion[a-z]*s$' + chr(39) + ')')}")
for _v, _k in (("lucene", "lucene"), ("robertson", "robertson"), ("bm25l", "bm25l")):
    _add(
        f"sql_bm25_opts_{_k}",
        _sql(f"SELECT doc_id, round(fts_bm25_opts(to_ftsdoc(text), '{_SCORED}', 10000D, 395D, array({', '.join(f'{x}D' for _, x in _W)}), 1.2D, 0.75D, '{_v}'), 6) AS score FROM quillon_documents"),
        _scalar_sql(_v),
    )
_add("sql_bm25_dfs", _sql(f"SELECT doc_id, round(fts_bm25_dfs(to_ftsdoc(text), '{_SCORED}', 10000D, 395D, array({', '.join(f'{x}D' for _, x in _W)})), 6) AS score FROM quillon_documents"), _scalar_sql("lucene"))
_add(
    "sql_literal_and_prose",
    _sql("SELECT doc_id, ftsdoc_length(to_ftsdoc(concat('''ok'':1 is how ', text))) AS analyzed, ftsdoc_length(ftsdoc('''a'':2 ''b'':3')) AS literal FROM quillon_documents"),
    f"WITH {_T} SELECT doc_id, CAST(len(w) + 4 AS INTEGER) AS analyzed, 5 AS literal FROM t",
)


def _repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inserted twice over, and then those of one source again with another text."""
    docs = _docs(spark, sf_dir, "text", "source")
    index = Index.create(spark, storage.scratch(spark, "index")).insert(docs.unionAll(docs)).flush()
    index = index.insert(docs.where("source = 'src1'").withColumn("text", F.lit("the of nothing")))
    return search.count(index, _LIFE).withColumn("ndocs", search.stats(index).select("ndocs").first()[0] * F.lit(1.0))


_add(
    "index_repeated_ids",
    _repeated_ids,
    f"WITH {_T} SELECT count(*) FILTER (WHERE source = 'src1' OR ({has('the')} AND {has('of')})) AS matches, CAST(count(*) AS DOUBLE) AS ndocs FROM documents JOIN t USING (doc_id)",
)


def _tidied(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, docs = _parts(spark, sf_dir)
    return _topk(index.delete(docs.where("source = 'src1'")).tidy(0.0)[0])


_add("index_tidy", _tidied, _REST)
_add("scan_search", lambda s, d: scan.search(_docs(s, d), "tion", 10).select("doc_id", F.round("score", 6).alias("score")), _ranked_sql({"tion": 1}))
_add("index_search", lambda s, d: search.search(_index(s, d), "tion", 10).select("doc_id", F.round("score", 6).alias("score")), _ranked_sql({"tion": 1}))
ORACLE["query_texts"] = "SELECT * FROM (VALUES " + ", ".join("('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in [(n, t, t) for n, t in _GOLDEN.items()]) + ") v(query, canonical, round_trip)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the documents, and the ten best for `the & of`."""
    return search.search(_index(spark, sf_dir), "the & of", 10)
