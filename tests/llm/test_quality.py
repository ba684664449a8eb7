"""Quality: texts are taken apart once, and their features are what they are said to be."""

import numpy as np
import pyarrow as pa

from caseflow.llm import linear, quality, textbuf


def test_texts_are_read_once(spark):
    """Scores come from the kept features: neither the join with the labels nor the scoring reads a text again."""
    docs = spark.createDataFrame([(i, "Plain words here.\nmore" if i % 2 else "x!! $$ 9 9", "extra") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.rank(spark, docs, labels)
    files = got.inputFiles()
    assert files and all("quality-features" in f for f in files)
    assert "text" not in spark.read.parquet(*files).columns
    scores = {r.doc_id: r.score for r in got.collect()}
    assert len(scores) == 60 and len(set(scores.values())) == 2 and scores[1] > scores[0]


def test_features_one_text_at_a_time():
    """Together as alone, and shares of kinds of characters, pairs and repeated words by hand."""
    texts = ["", "a", "Ab 12", "", "one two one two one", "é\n\nx\nx", "\n", "aaaa" * 50, None, "Zz (q) | 9%"]
    data, offsets = textbuf.buffers(pa.array(texts, pa.string()))
    got = quality.features(data, offsets)
    assert got.shape == (len(texts), quality.WIDTH)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (got[i] == quality.features(*textbuf.buffers(pa.array([t], pa.string())))[0]).all()
        size = max(1, len(raw))
        kinds = [np.float32(np.sqrt(sum(bool(k[c]) for c in raw) / size)) for k in quality._KINDS]
        assert got[i, : len(kinds)].tolist() == kinds
        pairs = np.zeros(quality.SHAPES)
        for p in range(len(raw) - 1):
            pairs[linear.gram_buckets(quality._SHAPE[np.frombuffer(raw[p : p + 2], np.uint8)], 2, quality.SHAPES)[0]] += 1
        assert got[i, -quality.SHAPES :].tolist() == np.sqrt(pairs / size).astype(np.float32).tolist()
    assert got[4, len(quality._KINDS) + 2] == np.float32(2 / 5)


def test_distinct_counts():
    values, bounds = np.array([3, 1, 3, 2, 2, 9], np.uint64), np.array([0, 0, 3, 5, 5, 6, 6])
    assert textbuf.distinct_counts(values, bounds).tolist() == [0, 2, 1, 0, 1, 0]
    assert textbuf.distinct_counts(values, bounds).tolist() == np.diff(textbuf.distinct(values, bounds)[1]).tolist()
