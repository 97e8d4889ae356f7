"""What the English analyzer keeps."""

from quillon.functions import english


def test_few_words_are_kept(monkeypatch):
    """A task kept all words that it met, up to a million of them."""
    monkeypatch.setattr(english, "_KEPT", 100)
    recent, asked = english._Recent("english"), []
    monkeypatch.setattr(english, "lexemes", lambda w, c: asked.append(w) or [w])
    for i in range(50):
        recent.age()
        for w in ["running", *(f"word{i}x{j}" for j in range(60))]:
            assert recent.terms(w) == (w,)
    assert len(recent.new) + len(recent.old) < 400 and asked.count("running") == 1
