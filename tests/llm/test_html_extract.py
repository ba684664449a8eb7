"""Extraction against known pages, the chain against all labelings, and the stated cases."""

import html
import itertools
import random
import re

import numpy as np

from caseflow.llm import html_extract as H


def want(p):
    a = p[p.index("<article>") + 9 :]
    a = a[: a.index("</article>")] if "</article>" in a else a
    a = re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?b>", m[0]) else " ", a)
    return " ".join(html.unescape(a).split())


def test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(spark, pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == want(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_cases(spark):
    long = "word " * 20000
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "no tags at all"), (4, "u", "<article><p>One &amp; tw<b>o</b>&nbsp;\n x<br>y<p>Three.</article><footer>f</footer>"),
        (5, "u", "<article><p>Text of it.</p><!-- > <p>no</p> --><script>var a='</p>'; if (a<b) {}</script><p>More text.<div class='ad'>Buy this now.</div></article>"),
        (6, "u", f"<body><nav><a href=x>Home</a></nav><main><p>{long}.</p></main></body>"), (6, "u", "<script>never closed <p>x</p>"), (7, "u", "<article><p>a < b and c > d 5</p></article>"),
        (None, "u", "<article><h1>T</h1><p title='>'>Quoted.</p></article><section id='comments'><p>I disagree with this.</p></section>"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string").repartition(2)
    got = {(r.page_id, r.url, len(r.text) > 1000): r.text for r in H.extract(spark, df).collect()}
    assert got[1, "u", False] == "" and got[2, None, False] == ""
    assert got[4, "u", False] == "One & two x y Three."
    assert got[5, "u", False] == "Text of it. More text."
    assert got[6, "u", True] == (long + ".").replace(" .", " .") and got[6, "u", False] == ""
    assert got[7, "u", False] == "a < b and c > d 5"
    assert got[None, "u", False] == "T Quoted."
    assert H.extract(spark, df.limit(0)).collect() == []


def test_viterbi_against_all_labelings():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        s, t = rng.normal(size=n).tolist(), rng.normal(size=(2, 2)).tolist()
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: sum(s[i] * y[i] for i in range(n)) + sum(t[a][b] for a, b in zip(y, y[1:])))
        assert H.viterbi(s, t) == list(best)


def test_unseen_composed_pages():
    rng = random.Random(7)
    model = H.train([H.composed(rng) for _ in range(200)])
    pages = [H.composed(random.Random(1000 + i)) for i in range(60)]
    hits = [a == b for p in pages for a, b in zip(H.viterbi([sum(model["w"].get(f, 0) for f in fs) for fs, _ in p], model["t"]), [y for _, y in p])]
    assert np.mean(hits) > 0.95
