"""The pipeline's stages on the smallest tables, each against a brute-force version on its own input."""

import numpy as np

import corpus_pipeline
from gridloom.llm import decontaminate, sentencepiece_codec, toxicity
from tests.llm.test_operators import brute_components, distance


def within_budget(texts, items):
    """Numbers of the texts that hold an item within a fifth of its words as edits: the whole edit table, a row at a time over all texts at once."""
    ids, gap = {}, max(map(len, items))
    rows, owner = [], []
    for i, t in enumerate(texts):
        w = decontaminate.normalised(t or "").split()
        rows += [ids.setdefault(x, len(ids) + 1) for x in w] + [0] * gap
        owner += [i] * (len(w) + gap)
    y, at, found = np.array(rows), np.arange(len(rows) + 1), set()
    for item in items:
        row = np.zeros(len(y) + 1, np.int64)
        for x in item:
            best = np.minimum(np.concatenate([[row[0] + 1], row[:-1] + (y != ids.get(x, -1))]), row + 1)
            row = np.minimum.accumulate(best - at) + at
        found |= {owner[j - 1] for j in np.flatnonzero(row[1:] <= int(len(item) * 0.2)) + 1}
    return found


def test_edit_table_equals_plain_one():
    items = [decontaminate.normalised(x).split() for x in ("a b c d e", "b b", "c d e f g h i j k l")]
    texts = ["x a b c e y", "b", "b b", "c d f g h i j k l", "", None, "a b c d e f g h i j", "c d x f g h i y k l z"]
    want = {i for i, t in enumerate(texts) if any(distance(p, decontaminate.normalised(t or "").split()) <= int(len(p) * 0.2) for p in items)}
    assert within_budget(texts, items) == want and want


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = toxicity.score_texts([r[1] for r in rows], model)
    want = [r for r, s in zip(rows, scores, strict=True) if s < 0.3]
    out = stages["toxicity"](spark, docs, sf)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(want)

    got = sorted(map(tuple, stages["exact_dedup"](spark, docs, sf).collect()))
    best = {}
    for r in rows:
        k = "".join(r[1].split())
        best[k] = min(best.get(k, r), r, key=lambda x: (-len(x[1]), x[0]))
    assert got == sorted(best.values())

    got = sorted(map(tuple, stages["ngram_jaccard_join"](spark, docs, sf).collect()))
    comp = brute_components([(r[0], r[1]) for r in rows])
    first = {c[2] for c in comp}
    assert got == sorted(r for r in rows if str(r[0]) in first)

    items = [p for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (p := decontaminate.normalised(r.text).split())]
    dirty = within_budget([r[1] for r in rows], items)
    got = sorted(map(tuple, stages["decontamination"](spark, docs, sf).collect()))
    assert got == sorted(r for i, r in enumerate(rows) if i not in dirty) and dirty

    sp = sentencepiece_codec.codec(sentencepiece_codec.MODEL).sp
    coded = stages["sentencepiece"](spark, docs, sf).collect()
    assert sorted((r.doc_id, r.ids, r.round_trip) for r in coded) == sorted((r[0], sp.encode(r[1]), True) for r in rows)


def test_stages_keep_other_columns_and_rows_of_any_order(spark, sf):
    """Nulls in any column, repeated rows, long texts, clashing names, an input that is dealt anew each time it is read."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(9000))
    near = " ".join(f"near{i}" for i in range(60))
    rows = [(i, t, None if i % 2 else "en", i) for i, t in enumerate(["one text here", "one  text here", None, None, "", near, near + " end", long, long + " x", "w" * 40_000, "   "])]
    rows += [(None, "lonely words without an id", None, None), (0, "one text here", "en", 0), (3, None, None, 3)]
    df = spark.createDataFrame([(*r, "r", 1, None) for r in rows], "doc_id long, text string, lang string, _row int, _uid string, row int, _row_ string").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    out = stages["exact_dedup"](spark, df, sf)
    assert out.columns == df.columns
    best = {}
    for r in rows:
        k = "".join((r[1] or "").split())
        best[k] = min(best.get(k, r), r, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
    assert sorted(map(str, [(r.doc_id, r.text, r["_row"]) for r in out.collect()])) == sorted(map(str, [(r[0], r[1], r[3]) for r in best.values()]))
    out = stages["ngram_jaccard_join"](spark, df, sf)
    assert out.columns == df.columns
    # wordless rows (2, 3, 3, 4, 10) stay; of 0, 1, 0 and of 5, 6 and of 7, 8 the first
    assert sorted(map(str, [r.doc_id for r in out.collect()])) == sorted(map(str, [0, 2, 3, 3, 4, 10, 5, 7, 9, None]))
    for name in ("toxicity", "decontamination"):
        out = stages[name](spark, df, sf)
        assert out.columns == df.columns and out.count() == len(rows)
    assert stages["sentencepiece"](spark, df, sf).count() == len(rows)


def test_run_applies_all_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < out.count() < n and out.columns[0] == "doc_id"


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
