"""The query language against known renderings, and properties of parser and renderer."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillon.functions import codec
from quillon.functions.registry import matches
from quillon.plans.query import Query, QuerySyntaxError, fold

RENDERED = [
    ("quick & brown", "('quick' & 'brown')"),
    ("quick | brown", "('quick' | 'brown')"),
    ("!slow", "!'slow'"),
    ("quick brown fox", "(('quick' & 'brown') & 'fox')"),
    ("(quick OR slow) AND fox", "(('quick' | 'slow') & 'fox')"),
    ("quick and not slow", "('quick' & !'slow')"),
    ("QUICK", "'quick'"),
    ("!!!!a", "!!!!'a'"),
    ("(((a)))", "'a'"),
    ("   ", ""),
    ("a | b & c", "('a' | ('b' & 'c'))"),
    ("foo-bar", "('foo' & !'bar')"),
    ('"a b c"', "(('a' <-> 'b') <-> 'c')"),
    ("NEAR(a b c, 3)", "('a' <-> ('b' <-> 'c'))"),
    ("qui*", "'qui'*"),
    ("quik~", "'quik'~2"),
    ("quik~0", "'quik'~1"),
    ("/Qu.ck/", "/Qu.ck/"),
    ("a /never ends", "'a'"),
    ("İSTANBUL ΣΑΣ", "('istanbul' & 'σασ')"),
]


@pytest.mark.parametrize(("text", "want"), RENDERED)
def test_rendering(text, want):
    assert str(Query.parse(text)) == want


@pytest.mark.parametrize("text", ["quick &", "(quick", "a & & b", '""', '"e-mail"', "NEAR(one, 2)", "NEAR(a b, 0)", "NEAR(a b, x)", "a, b", '"a or b"', "a)", "NEAR a"])
def test_faults(text):
    with pytest.raises(QuerySyntaxError, match="syntax error in ftsquery"):
        Query.parse(text)


def test_near_without_distance_and_long_nesting():
    assert Query.parse("NEAR(a c)").items[-1].distance == 10
    assert str(Query.parse("(" * 100 + "a" + ")" * 100)) == "'a'"


@pytest.mark.parametrize(("text", "want"), [("'quick' & 'brown'", "('quick' & 'brown')"), ("!'slow' & 'quick'", "(!'slow' & 'quick')"), ("( 'a' | 'b' ) & !'c'", "(('a' | 'b') & !'c')"), ("'quick' <-> 'brown'", "('quick' <-> 'brown')"), ("a:*B & b:AC", "('a' & 'b')"), ("", "")])
def test_from_tsquery(text, want):
    assert str(Query.from_tsquery(text)) == want
    assert Query.from_tsquery("'a' <3> 'b'").items[-1].distance == 3


WORDS = st.sampled_from(["a", "b", "c", "zürich", "d1"])
TREES = st.recursive(
    st.one_of(WORDS, WORDS.map(lambda w: w + "*"), WORDS.map(lambda w: w + "~1"), st.lists(WORDS, min_size=2, max_size=3).map(lambda x: '"' + " ".join(x) + '"'), st.lists(WORDS, min_size=2, max_size=3).map(lambda x: f"NEAR({' '.join(x)}, 2)")),
    lambda t: st.one_of(t.map(lambda x: f"!({x})"), st.tuples(t, st.sampled_from([" ", " & ", " | ", " and "]), t).map(lambda x: f"({x[0]}{x[1]}{x[2]})")),
    max_leaves=8,
)


@given(TREES)
def test_bytes_round_trip(text):
    q = Query.parse(text)
    assert Query.from_bytes(q.to_bytes()) == q


@given(TREES)
def test_rendering_of_plain_terms_parses_again(text):
    q = Query.parse(text)
    if "<->" not in str(q) and not any(i.flags for i in q.items):  # the marks of patterns stand behind quotes, for display
        assert Query.parse(str(q)) == q


@given(st.binary(max_size=60))
def test_bytes_never_crash(data):
    for read in (Query.from_bytes, codec.from_bytes):
        try:
            read(data)
        except ValueError:
            pass


@given(st.text(max_size=80))
def test_any_text_parses_or_is_a_syntax_error(text):
    try:
        Query.parse(text)
    except QuerySyntaxError:
        pass


@given(st.text(max_size=80))
def test_documents_round_trip(text):
    doc = codec.analyze(text)
    assert codec.from_bytes(codec.to_bytes(doc)) == doc
    assert doc["doclen"] == sum(t["tf"] for t in doc["terms"])


def test_fold_is_by_character():
    assert fold("ÉCOLE İ ΣΑΣ ß") == "école i σασ ß"


CANONICAL = [
    ("'ok':1 'unterminated:1", "unterminated quoted term"),
    ("'ok':1 'a':0", "term frequency must be at least 1"),
    ("'b':1@2 'a':1@1", "sorted and distinct"),
    ("'a':2@5,5", "ascending"),
    ("'a':2@1", "expected 2 positions for tf=2"),
    ("'ok':1 'bad", "unterminated quoted term"),
    ("'ok':1 'x':abc", "expected term frequency"),
    ("'z':1@ ", "expected a position"),
    ("'a':1@1 'b':1", "for every term or none"),
    ("'a':1@1,2", "more than tf=1"),
    ("'a':1 b", "expected a quoted term"),
]


@pytest.mark.parametrize(("text", "message"), CANONICAL)
def test_malformed_documents(text, message):
    with pytest.raises(codec.MalformedDocument, match=message):
        codec.parse(text)


def test_canonical_documents():
    doc = codec.parse("'brown':1@3 'fox':2@2,5 'quick':1@1")
    assert [(t["term"], t["tf"], t["pos"]) for t in doc["terms"]] == [("brown", 1, [3]), ("fox", 2, [2, 5]), ("quick", 1, [1])]
    assert [t["term"] for t in codec.parse("'a''b':1@1 'c\\\\d':1@2")["terms"]] == ["1", "2", "a", "b", "c", "d"]
    assert codec.parse("'don\\'t':1@1")["terms"][0]["term"] == "don't"
    assert codec.from_tsvector("'cat':3A,1 'dog'")["terms"] == [{"term": "cat", "tf": 2, "pos": None}, {"term": "dog", "tf": 1, "pos": None}]


def test_single_matches():
    doc = codec.analyze("the quick brown red fox jumps")
    for q, want in (("NEAR(quick fox, 3)", True), ("NEAR(quick fox, 2)", False), ("NEAR(quick fox, 3) & jumps", True), ("", False), ("!slow", True), ("/^qu.*k$/", True), ("quik~1", True)):
        assert matches(doc, Query.parse(q)) is want, q
