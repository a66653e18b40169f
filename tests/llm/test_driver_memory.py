"""What the pipeline asks of the driver: few steps over links that are stars already, and features of the words at hand only."""

import importlib
import random

import numpy as np
from siltstone.llm import langid

steps = importlib.import_module("siltstone.llm.components")


def plain(edges):
    """The least node reachable, by edges."""
    least = {x: x for e in edges for x in e}
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def test_stars_take_no_step_and_further_links_join_components(spark, monkeypatch):
    taken, real = [], steps._stars
    monkeypatch.setattr(steps, "_stars", lambda edges, large: taken.append(large) or real(edges, large))
    table = lambda edges: spark.createDataFrame(edges, "a long, b long")
    got = lambda df: sorted((r.node, r.component) for r in df.collect())
    stars = [(1, n) for n in range(2, 40)] + [(50, 51), (52, 50), (60, 60)]
    found = steps.components(table(stars))
    assert got(found) == sorted(plain([e for e in stars if e[0] != e[1]]).items()) and not taken

    # within a component, between leaves of two, from a leaf to a node of no component, and between two such nodes
    more = [(3, 4), (39, 52), (51, 45), (0, 45), (70, 71)]
    assert got(steps.merged(found, table(more))) == sorted(plain([e for e in stars if e[0] != e[1]] + more).items())
    assert got(steps.merged(found, table(more).limit(0))) == got(found)


def test_merged_components_of_random_links(spark):
    random.seed(4)
    table = lambda edges: spark.createDataFrame(edges, "a long, b long")
    edges = [tuple(random.sample(range(150), 2)) for _ in range(130)]
    found = steps.components(table(edges[:60]))
    for cut, end in ((60, 90), (90, 130)):
        found = steps.merged(found, table(edges[cut:end]))
    rows = found.collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.component for r in rows} == plain(edges)


def test_learning_takes_features_of_the_batch_only(monkeypatch):
    seen, real = [], langid.word_features
    monkeypatch.setattr(langid, "word_features", lambda data, starts, ends: seen.append((len(data), int((ends - starts).sum()))) or real(data, starts, ends))
    model = langid.fit(["the sun and the moon " * 2000] * 3 + ["der mond und die sonne " * 2000] * 3, ["en"] * 3 + ["de"] * 3)
    assert len(seen) > 2 and all(held == words for held, words in seen)
    data = np.frombuffer(b"one  two three one", np.uint8)
    starts, ends = np.array([5, 0, 9]), np.array([8, 3, 14])
    whole, alone = real(data, starts, ends), real(*langid.apart(data, starts, ends))
    assert all(np.array_equal(x, y) for x, y in zip(whole, alone)) and model.languages == ["de", "en"]
