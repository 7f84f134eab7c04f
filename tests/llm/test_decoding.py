"""The Viterbi decode of character lattices against all decodings of short tokens."""

import itertools
import random

import pytest

from tilecairn.llm import toxicity
from tilecairn.llm.toxicity import Letters, Model, lattice, letter_counts, viterbi

LETTERS = Letters.of(letter_counts(["such a stupid man saw a calm house by the river and he walks slowly to the idiot of the valley with all the good letters"] * 50))


def exhaustive(token, run):
    """The cheapest of all ways through the lattice."""
    best = None
    for way in itertools.product(*lattice(token, run)):
        a = b = 0
        cost = 0.0
        for x, extra in way:
            cost += extra
            for c in x:
                i = toxicity._INDEX.get(c, 0)
                cost += LETTERS.cost[a, b, i]
                a, b = b, i
        value = (cost + LETTERS.cost[a, b, 0], "".join(x for x, _ in way))
        if best is None or value < best:
            best = value
    return best[1]


@pytest.mark.parametrize("run", [False, True])
def test_decoding_is_the_cheapest_of_all(run):
    r = random.Random(6)
    for _ in range(300):
        token = "".join(r.choice("stupidoiaal1035!$.-u") for _ in range(r.randint(1, 6)))
        assert viterbi(token, LETTERS, run) == exhaustive(token, run)
    for token in ("st*p", "i*", "$tuuu"):
        assert viterbi(token, LETTERS, run) == exhaustive(token, run)


def test_repetition_leetspeak_and_spacing():
    m = Model(LETTERS)
    assert [m.restored(t) for t in ("stuupid", "stuuuupid", "5tup1d", "1d10t", "letter", "good", "house,", "2024", "...")] == ["stupid", "stupid", "stupid", "idiot", "letter", "good", "house", "2024", ""]
    assert m.restored("the.idiot") == "the idiot" and m.restored("s.t.u.p.i.d") == "stupid"
    assert "stupid" in m.restored("astupid", run=True).split(" ")
    for n in (63, 64, 65, 66, 200):  # no length at which decoding ends
        assert m.restored("stup" + "i" * (n - 5) + "d") == "stupid"
    assert m.restored("ааа") == "ааа"  # letters of another alphabet stay
    assert m.restored("$tupid") == "stupid" and m.restored("!idiot!!") == "idiot" and m.restored("(the,") == "the"
    used = Model(LETTERS, {"stupid ": 1.0, "idio": 1.0})
    assert all(set(used.hits(t)) == set(f for f in used.features(t) if f in used.used) for t in ("stupid,", "(idiot)", "$tupid", "1d10t", "the", "st.upid", "stupid###", "i d i o t", "x"))
