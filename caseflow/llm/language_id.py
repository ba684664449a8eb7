"""Language by hierarchical discrimination: first the family, then one-versus-one linear support vector machines within it.

Texts are profiles of hashed byte trigrams of their letters. The family is the one-versus-rest machine with the highest margin; within the family
each pair of languages has a machine, votes decide and margins break ties. Models learn from a bounded sample of labelled
texts; the scores of a whole text are sums over all its trigrams.

Defined results: `und` with score 0 for a null text or one without a letter; a table without labelled rows gives `und` for all;
one learned language is given to every text with a letter; repeated rows get equal results; an empty table gives no rows;
extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, textbuf
from .common import cut_lineage, held_out, map_batches

#: Labelled texts per language that the machines learn from at most, chosen by a hash of the text.
SAMPLE_PER_LANGUAGE = 400
FAMILIES = {  # a fixed table of public knowledge: language code to family; a code not listed is a family of its own
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "pt", "it", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indo-aryan": ["hi", "bn", "mr", "ur", "pa", "gu", "ne"],
    "semitic": ["ar", "he", "mt", "am"],
}
_SEPARATORS = ~textbuf.ALNUM
_SEPARATORS[0x30:0x3A] = True  # digits tell nothing of a language
BUCKETS = 1 << 12


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def letters(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes with every other run of bytes as blanks."""
    low = textbuf.LOWER[data]
    return np.where(_SEPARATORS[low], np.uint8(0x20), low)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, use) at each place, and bounds: trigrams that lie within a text and are not all blanks."""
    low = letters(data)
    g = linear.gram_buckets(low, 3, BUCKETS)
    use = (low[:-2] != 0x20) | (low[1:-1] != 0x20) | (low[2:] != 0x20) if len(low) >= 3 else np.zeros(0, bool)
    use &= ~((low[:-2] == 0x20) & (low[1:-1] == 0x20)) if len(low) >= 3 else use
    bounds = np.minimum(offsets, len(g))
    for back in (1, 2):
        at = offsets[1:-1] - back
        use[at[(at >= 0) & (at < len(g))]] = False
    return g, use, bounds


def profiles(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS + 1): trigram frequencies of length one, and a constant."""
    out = np.zeros((len(texts), BUCKETS + 1), np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer(f" {t} ".encode(), np.uint8)
        g, use, _ = _grams(data, np.array([0, len(data)]))
        out[i, :-1] = np.bincount(g[use], minlength=BUCKETS)
        out[i, :-1] = np.sqrt(out[i, :-1] / max(1.0, out[i, :-1].sum()))
    out[:, -1] = 0.1
    return out


def sample(docs: DataFrame, most: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """(lang, text) of a bounded number of different texts per language; each gives one stretch of 2,000 characters at a hashed place."""
    from pyspark.sql import Window as W

    rows = docs.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    span = F.greatest(F.length("text") - 2000, F.lit(1))
    # copies of a text are one: their hashes are combined and numbered before any text moves
    rn = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    first = cut_lineage(rows.groupBy("lang", "h").agg(F.lit(1)).select("lang", "h", rn.alias("rn")).where(F.col("rn") <= most), "language-sample")
    cut = rows.join(F.broadcast(first), ["lang", "h"]).select("lang", "rn", F.substring("text", F.pmod("h", span).cast("int") + 1, F.lit(2000)).alias("part"))
    return [(r["lang"], r["part"]) for r in cut.groupBy("lang", "rn").agg(F.min("part").alias("part")).orderBy("lang", "rn").collect()]


def train(rows: list[tuple[str, str]]) -> dict:
    langs = sorted({x for x, _ in rows})
    groups = sorted({family(x) for x in langs})
    model = {"langs": langs, "families": groups, "rest": {}, "pairs": {}}
    if len(langs) < 2:
        return model
    x = profiles([t for _, t in rows])
    y = np.array([langs.index(a) for a, _ in rows])
    fam = np.array([groups.index(family(a)) for a, _ in rows])
    for g in range(len(groups)) if len(groups) > 1 else ():
        model["rest"][g] = linear.svm(x, np.where(fam == g, 1.0, -1.0), 4.0).astype(np.float32)
    for g in range(len(groups)):
        own = [i for i, a in enumerate(langs) if family(a) == groups[g]]
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                rows_ab = (y == a) | (y == b)
                model["pairs"][a, b] = linear.svm(x[rows_ab], np.where(y[rows_ab] == a, 1.0, -1.0), 4.0).astype(np.float32)
    return model


def predict(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number, score) of every text, from all its trigrams."""
    n = len(offsets) - 1
    if len(model["langs"]) < 2:
        return np.zeros(n, np.int64), np.ones(n)
    # each text between blanks, so that first and last letters count as such
    sizes = np.diff(offsets)
    at = np.repeat(np.arange(n) * 2 + 1, sizes) + np.arange(len(data))
    padded = np.full(len(data) + 2 * n, 0x20, np.uint8)
    padded[at] = data
    g, use, bounds = _grams(padded, offsets + 2 * np.arange(n + 1))
    who = np.repeat(np.arange(n), np.diff(bounds))[use[: bounds[-1]]]
    cell = who * BUCKETS + g[: bounds[-1]][use[: bounds[-1]]]
    # counts of each text's buckets: a histogram for few texts at a time
    margins = {}
    machines = {("rest", k): w for k, w in model["rest"].items()} | {("pair", k): w for k, w in model["pairs"].items()}
    total = np.maximum(1, np.bincount(who, minlength=n))
    for k in machines:
        margins[k] = np.empty(n)
    step = max(1, (1 << 22) // BUCKETS)
    edges = np.searchsorted(who, np.arange(0, n + step, step))
    for j, a in enumerate(range(0, n, step)):
        b = min(a + step, n)
        h = np.bincount(cell[edges[j] : edges[j + 1]] - a * BUCKETS, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
        h = np.sqrt(h / total[a:b, None], dtype=np.float32)
        for k, w in machines.items():
            margins[k][a:b] = h @ w[:-1] + 0.1 * w[-1]
    langs, groups = model["langs"], model["families"]
    rest = np.stack([margins["rest", g] for g in range(len(groups))]) if len(groups) > 1 else np.zeros((1, n))
    group = rest.argmax(0)
    sure = linear.sigmoid(2 * rest.max(0)) if len(groups) > 1 else np.ones(n)
    votes, strength = np.full((len(langs), n), -1.0), np.zeros((len(langs), n))
    for i, a in enumerate(langs):
        votes[i][group == groups.index(family(a))] = 0
    for (a, b), _ in model["pairs"].items():
        m = margins["pair", (a, b)]
        mine = group == groups.index(family(langs[a]))
        votes[a] += mine & (m >= 0)
        votes[b] += mine & (m < 0)
        strength[a] += m * mine
        strength[b] -= m * mine
    best = (votes + 1e-3 * np.tanh(strength)).argmax(0)
    others = np.array([max(1, sum(family(x) == family(a) for x in langs) - 1) for a in langs])
    inner = np.where(others[best] * 0 + np.array([sum(family(x) == family(a) for x in langs) for a in langs])[best] > 1, linear.sigmoid(2 * strength[best, np.arange(n)] / others[best]), 1.0)
    return best, np.clip(sure * inner, 0, 1)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang)."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = spark.sparkContext.broadcast(train(sample(docs)))

    def run(batch):
        model = shared.value
        data, offsets = textbuf.buffers(batch["text"])
        langs, scores = [], []
        for a, b in textbuf.byte_slices(offsets, 4 << 20):
            l, s = predict(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            langs.append(l)
            scores.append(s)
        names = np.array([*model["langs"], "und"], object)
        l, s = np.concatenate(langs), np.concatenate(scores)
        known = np.array(batch["lettered"].to_pylist(), bool) & bool(model["langs"])
        return pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": pa.array(names[np.where(known, l, -1)], pa.string()), "score": pa.array(np.where(known, s, 0.0)),
        })

    rows = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return map_batches(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
