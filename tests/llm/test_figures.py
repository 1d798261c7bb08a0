"""Captions of figures, wherever they stand."""

from __future__ import annotations

import pytest

from tranche.llm.media import items_of


@pytest.mark.parametrize(("html", "want"), [
    ("<figure><figcaption>C</figcaption><img src=a alt=x></figure>t", [("a", "C"), ("t", None)]),
    ("<figure><img src=a alt=x><figure><img src=b alt=y><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>", [("a", "out"), ("b", "in")]),
    ("<figure><figcaption>out</figcaption><figure><img src=b alt=y></figure></figure><img src=c alt=z>", [("b", "out"), ("c", "z")]),
    ("<figure>s<figcaption>C</figcaption>t</figure>u", [("s", None), ("C", None), ("t", None), ("u", None)]),
    ("<figure><figcaption>C</figcaption><img src=a alt=x>", [("a", "C")]),
    ("<figcaption>C</figcaption><img src=a alt=x></figure>", [("C", None), ("a", "x")]),
])
def test_captions(html, want):
    assert [(x["text"] or x["source"], x["caption"]) for x in items_of(html)] == want
