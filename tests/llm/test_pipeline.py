import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
import fixtures as X  # noqa: E402

from lakeloom.llm import exact_dedup, ngram_join, quality  # noqa: E402


def test_stages_are_chained_and_keep_columns(spark, tmp_path):
    rows = []
    for i in range(40):
        rows.append((i, " ".join(f"w{(i * 37 + k * k) % 211}z" for k in range(70)) + "."))
    rows += [(100, rows[3][1]), (101, rows[4][1].replace("w", "w", 1) + " extra"), (102, "short"), (103, None), (104, " ".join("$$$a|" for _ in range(80)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "packing"]
    kept = dict(rows)
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns
        ids = {r.doc_id for r in frame.select("doc_id").collect()}
        before = spark.createDataFrame([(i, kept[i]) for i in kept], "doc_id long, text string")
        if name == "quality rules":
            assert ids == {r.doc_id for r in quality.quality_rules(before).filter("kept").collect()} and not ids & {102, 103, 104} and set(range(40)) <= ids
        elif name == "exact dedup":
            assert ids == {r.doc_id for r in exact_dedup.exact_dedup(before).filter("kept").collect()} and 100 not in ids
        else:
            assert ids == {r.doc_id for r in ngram_join.ngram_join(before).collect() if r.doc_id == r.component_id} and 101 not in ids
        kept = {i: kept[i] for i in ids}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(kept)


def test_stages_judge_rows_with_null_and_repeated_ids(spark):
    text = lambda i: " ".join(f"w{(i * 37 + k * k) % 211}z" for k in range(70)) + "."
    rows = [(i, text(i), "a") for i in range(30)] + [(None, text(50), "a"), (None, text(51), "a"), (None, text(3), "a"), (5, "short", "a"), (6, text(60), "a"), (7, text(7), "a"), (7, text(7), "b"), (None, text(50), "a"), (None, text(8) + " more", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    read = lambda frame: sorted(((r.doc_id, r.text, r.source) for r in frame.collect()), key=repr)
    good = stages["quality rules"](spark, docs, "")
    expected = [r for r in rows if r[1] != "short"]
    assert read(good) == sorted(expected, key=repr)
    exact = stages["exact dedup"](spark, good, "")
    expected = [r for r in dict.fromkeys(expected) if r not in ((None, text(3), "a"), (7, text(7), "b"))]
    assert exact.columns == docs.columns and read(exact) == sorted(expected, key=repr)
    near = stages["n-gram Jaccard join"](spark, exact, "")
    assert read(near) == sorted((r for r in expected if r[1] != text(8) + " more"), key=repr)


def test_components_agree_with_stage_rule():
    found = X.components([(3, "a b c d e f"), (1, "a b c d e f"), (2, "z")])
    assert found == {3: (2, 1), 1: (2, 1), 2: (1, 2)}
