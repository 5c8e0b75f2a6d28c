"""The composed clause grammar against a plain reading of each word's neighbours."""

import random

import pytest

from pagewarden.llm import toxicity as T

LEXICON = T.Lexicon(("grumpf",))


def brute_force(tokens):
    out = []
    for clause in " ".join("." if t in T._ENDS else t for t in tokens).split("."):
        words = clause.split()
        kinds = [LEXICON.get(w) for w in words]
        found = []
        for at, kind in enumerate(kinds):
            if kind not in (T.INSULT, T.THREAT):
                continue
            before, after = kinds[max(0, at - T.REACH) : at], kinds[at + 1 : at + 1 + T.REACH]
            if kind == T.INSULT:
                form = "aimed insult" if T.TARGET in before + after else "insult"
            elif T.TARGET not in after:
                form = "threat"
            else:
                form = "vowed threat" if T.INTENT in before else "aimed threat"
            found.append(4 * T.FORMS.index(form) + 2 * (T.NEGATION in before) + (T.REPORT in kinds[:at]))
        if words:
            out.append(found)
    return out


def test_machine_reads_as_brute_force():
    rng = random.Random(3)
    vocabulary = ["idiot", "grumpfling", "kill", "burning", "you", "not", "said", "will", "a", "b", "c", "d", ".", "!", "\n"]
    for _ in range(2000):
        tokens = rng.choices(vocabulary, k=rng.randint(0, 30))
        assert T.patterns(tokens, LEXICON) == brute_force(tokens)


@pytest.mark.parametrize("text, form, negated, reported", [
    ("an idiot stood there", "insult", 0, 0),
    ("idiots like you", "aimed insult", 0, 0),
    ("idiot, that is what you are", "aimed insult", 0, 0),
    ("you are not stupid", "aimed insult", 1, 0),
    ("she said after the long show it was trash", "insult", 0, 1),
    ("kill the process", "threat", 0, 0),
    ("burn them", "aimed threat", 0, 0),
    ("i will hurt you", "vowed threat", 0, 0),
    ("i will never hurt you", "vowed threat", 1, 0),
])
def test_forms(text, form, negated, reported):
    (clause,) = T.patterns(T._TOKEN.findall(text), LEXICON)
    assert clause == [4 * T.FORMS.index(form) + 2 * negated + reported]


def test_only_clauses_count():
    one, other = (T.matches(t, LEXICON) for t in ("you idiot idiot. a b.", "you idiot. a b."))
    assert (one[: T.PATTERNS] == other[: T.PATTERNS]).all()
    # A target, a negation or a report of another clause does not reach.
    assert T.patterns(T._TOKEN.findall("not you. said. idiot. you"), LEXICON)[2] == [0]
    assert len(T.matches("word " * 200_000 + "idiot", LEXICON)) == T.WIDTH
