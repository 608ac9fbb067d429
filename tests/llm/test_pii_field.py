"""The skip-chain field: fitting and loopy messages against enumeration on small graphs, similar keys."""

import itertools

import numpy as np

from weftgraph.llm import pii


def exact(n, field):
    """Marginals by summing over all labelings."""
    unary = n.features @ field.unary
    unary[~n.allowed] -= pii.EVIDENCE
    known = np.flatnonzero(n.labels)
    unary[known, n.labels[known]] += 2 * pii.EVIDENCE
    chain, skip = pii._edges(n)
    total = np.zeros((len(n.labels), pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=len(n.labels)):
        score = sum(unary[i, x] for i, x in enumerate(labels))
        score += sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
        for i, x in enumerate(labels):
            total[i, x] += np.exp(score)
    return total / total.sum(1, keepdims=True)


def test_loopy_marginals_are_near_the_exact_ones():
    rng = np.random.default_rng(5)
    field = pii.Field(rng.normal(0, 0.3, (pii.FEATURES, pii.LABELS)), rng.normal(0, 0.3, (pii.LABELS, pii.LABELS)), np.eye(pii.LABELS) * 1.2)
    text = "tel 5550100200 5550100200 a@b.org 5550100201 5550100200"
    n = pii.nodes_of(text, pii.base_spans(text))
    chain, skip = pii._edges(n)
    assert len(n.labels) <= 7 and len(skip) >= 2 and len(chain) + len(skip) >= len(n.labels)  # with a loop
    got, want = pii.marginals(n, field), exact(n, field)
    assert np.abs(got - want).max() < 0.1 and (got.argmax(1) == want.argmax(1)).all()


def test_similar_keys_are_linked():
    n = pii.nodes_of("id ab12345 and ab12346 and zz99", [])
    assert (0, 1) in {tuple(e) for e in pii._edges(n)[1].tolist()}


def test_fit_raises_the_likelihood_of_agreement():
    texts = [f"mail x{k}@y.org or x{k}@y.org, code 77{k} 77{k} a1" for k in range(40)]
    samples = [pii.nodes_of(t, pii.base_spans(t)) for t in texts]
    field = pii.fit(samples)
    assert field.skip[1, 1] > field.skip[1, 0] and all((pii.marginals(s, field).argmax(1) == s.labels).all() for s in samples)
