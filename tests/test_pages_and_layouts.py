import numpy as np
import pytest

from lattica.operators import layout
from lattica.sources import web_pages

HTML = """<html><title> A &amp; <b>B</b></title><!-- <a href="/no">no</a> --><script>"<a href='/no'>"</script><body><a class=x href='/one?q=1'>One <i>two</i></a><a href="b/c">x</a><a href="//h/z"></a><a href="mailto:a@b">m</a><a name="n">none</a><a href="?p=2">next</a>
<table><thead><tr><th>Status</th><th>Title</th></tr></thead><tr><td>Final</td><td><A HREF="/d1">Doc &lt;1&gt;</A></td></tr><tr><td>Draft</td><td>no link</td></tr></table><table><tr><td><a href="x.pdf">Bare</a></td><td>Guide</td><td>2001</td></tr></table></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://h.org/a/page?x#y", HTML), (2, "https://h.org", None), (3, None, ""), (4, "https://h.org", "<table><tr><td>" * 500)], "id long, url string, html string")


def test_links(pages):
    found = {(r["id"], r["place"]): (r["href"], r["url"], r["label"]) for r in web_pages.links(pages, "id").collect()}
    assert [found[1, i] for i in range(5)] == [("/one?q=1", "https://h.org/one?q=1", "One two"), ("b/c", "https://h.org/a/b/c", "x"), ("//h/z", "https://h/z", None), ("mailto:a@b", "mailto:a@b", "m"), ("?p=2", "https://h.org/a/page?p=2", "next")]
    assert {k[0] for k in found} == {1} and pages.select(web_pages.title(pages["html"]).alias("t")).first()["t"] == "A & B"


def test_tables(pages):
    rows = [(r["table"], r["row"], r["header"], r["cells"]) for r in web_pages.table_rows(pages, "id").filter("id = 1").orderBy("table", "row").collect()]
    assert rows == [(0, 0, True, ["Status", "Title"]), (0, 1, False, ["Final", "Doc <1>"]), (0, 2, False, ["Draft", "no link"]), (1, 0, False, ["Bare", "Guide", "2001"])]
    docs = [tuple(r)[3:] for r in web_pages.listed_documents(pages, "id").orderBy("table", "row").collect()]
    assert docs == [("Doc <1>", "https://h.org/d1", None, None, "Final"), ("Bare", "https://h.org/a/x.pdf", "Guide", "2001", None)]


def test_levels_and_rings(spark):
    degrees = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1), ("d", 1)], "id string, degree long")
    assert {r["id"]: (r["x"], r["y"]) for r in layout.levels(degrees).collect()} == {"a": (0.0, 0.0), "b": (-22.5, 100.0), "c": (0.0, 100.0), "d": (22.5, 100.0)}
    found = {r["id"]: (round(r["x"], 6), round(r["y"], 6)) for r in layout.rings(degrees, "a").collect()}
    assert found["a"] == (0, 0) and found["b"] == (100, 0) and len(found) == 4
    assert len(layout.rings(degrees, "nobody").collect()) == 4


def test_forces(spark, monkeypatch):
    ring = [("one", f"n{i}", f"n{(i + 1) % 6}") for i in range(6)] + [("two", "a", "b"), ("two", "a", "b"), ("two", "c", "d"), ("two", "a", None), ("two", "e", "e")]
    edges = spark.createDataFrame(ring, "picture string, src string, dst string")
    at = {(r["picture"], r["id"]): np.array([r["x"], r["y"]]) for r in layout.forces(edges, "picture").collect()}
    assert len(at) == 11 and all(np.isfinite(v).all() for v in at.values())
    apart = lambda p, a, b: np.linalg.norm(at[p, a] - at[p, b])
    assert apart("two", "a", "b") < apart("two", "a", "c") and apart("two", "c", "d") < apart("two", "b", "d")
    assert np.mean([apart("one", f"n{i}", f"n{(i + 1) % 6}") for i in range(6)]) < np.mean([apart("one", f"n{i}", f"n{(i + 3) % 6}") for i in range(6)])
    monkeypatch.setattr(layout, "MOST_DRAWN", 5)
    with pytest.raises(ValueError):
        layout.forces(edges, "picture")
