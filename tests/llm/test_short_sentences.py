"""Repeated passages of short sentences go whole."""

import random

import pytest

from strandline.llm import spans


def passage(lengths):
    r = random.Random(6)
    return " ".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "." for n in lengths)


@pytest.mark.parametrize("lengths", [[3] * 20, [1, 8] * 7, [8, 1] * 7, [1] * 60, [11, 1] + [2] * 25])
def test_a_repeated_passage_of_short_sentences_is_removed(docs_of, lengths):
    said = passage(lengths)
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(20)) + "."
    rows = [(i, f"{own(i)} {said} {own(i + 100)}", "en", "a") for i in range(3)]
    got = {r.doc_id: r for r in spans.drop_repeats(docs_of(rows)).collect()}
    assert [got[i].n_removed for i in range(3)] == [0, len(lengths), len(lengths)]
    assert [got[i].text for i in (1, 2)] == [f"{own(i)} {own(i + 100)}" for i in (1, 2)]


def test_every_sentence_is_in_a_run_and_all_runs_are_long_enough():
    r = random.Random(7)
    for _ in range(200):
        n = [r.choice((1, 1, 2, 3, 8, 24)) for _ in range(r.randrange(1, 30))]
        runs = spans.shortest_runs(n, 2, 12)
        assert all(b - a >= 2 and sum(n[a:b]) >= 12 for a, b in runs)
        want = set(range(len(n))) if len(n) > 1 and sum(n) >= 12 else set()
        assert {k for a, b in runs for k in range(a, b)} == want
        assert want == set() or {(0, b) for a, b in runs if a == 0} and {(a, b) for a, b in runs if b == len(n)}
