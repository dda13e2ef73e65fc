import corpus_pipeline
import pytest
from pathlib import Path

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")
def test_stages_keep_columns_and_clean_documents(spark):
    from rollspan.session import cut

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bad = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 0").collect()}
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER))
        if name == "quality classifier":
            kept = {r["doc_id"] for r in docs.collect()}
            assert len(kept & bad) <= 0.1 * len(bad)
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    assert docs.select("doc_id").distinct().count() == sizes[-1]


GOOD = (
    "The committee met in the morning and spoke at length about the new bridge. Most members agreed "
    "that it should be built soon, {0}, since the old one had been closed for years. They asked the "
    "engineer for a plan of {0} and its costs, and the meeting ended before noon."
)
BAD = "$$$ ### click|here|now ### $$$ !!! " * 30
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def small_folder(spark, tmp_path):
    """Tables of a folder with these documents, labels of both kinds and no benchmark item."""

    def write(rows):
        docs = spark.createDataFrame([(d, t, "en", "web", len(t) if t else None) for d, t in rows], COLUMNS)
        folder = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        docs.write.parquet(f"{folder}/documents.parquet")
        learned = [(1000 + i, i % 2, 0) for i in range(80)] if rows else []
        spark.createDataFrame(learned, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        return folder, spark.read.parquet(f"{folder}/documents.parquet")

    return write


def training():
    """Eighty documents whose quality is plain."""
    out = []
    for i in range(80):
        words = " ".join(f"w{i}x{k} and the" for k in range(5 + i % 9))
        out.append((1000 + i, GOOD.format(words) if i % 2 else BAD + words))
    return out


def test_rows_are_judged_by_their_own_text(spark, small_folder):
    good = GOOD.format("as the river allows")
    rows = training() + [(1, BAD), (1, good), (None, BAD), (None, GOOD.format("x y z " * 9)), (2, good), (2, good), (3, None), (4, "")]
    folder, docs = small_folder(rows)
    kept = corpus_pipeline.quality_classifier(spark, docs, folder)
    texts = sorted(str((r["doc_id"], r["text"][:30])) for r in kept.collect() if r["text"] and (r["doc_id"] or 0) < 1000)
    assert texts == sorted(str((d, GOOD[:30])) for d in (1, None, 2, 2))
    alone = corpus_pipeline.near_duplicates(spark, kept, folder)
    left = sorted(str(r["doc_id"]) for r in alone.collect() if r["text"] and (r["doc_id"] or 0) < 1000)
    assert left == ["1", "None"]


def test_the_whole_pipeline_on_odd_and_empty_tables(spark, small_folder):
    folder, _ = small_folder(training() + [(1, None), (2, ""), (None, " \t"), (3, "one"), (3, "one"), (4, GOOD.format("my phone is 555-123-4567"))])
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} >= {4} and sum(r["length"] for r in pieces) > 1000
    folder, docs = small_folder([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
