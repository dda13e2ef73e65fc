from rollspan.llm import templates

ITEM = (
    "Yesterday the farmer John sold 12 kg of apples for 30 dollars and then John gave 5 pears "
    "to his friend Mary before noon. How many pears does Mary have now?"
)
REWORDED = (
    "yesterday the farmer Peter sold 7 kg of apples for 45 dollars and then Peter gave 2 pears "
    "to his friend Susan before noon. How many pears does Susan have now?"
)
CLASHING_VALUES = REWORDED.replace("then Peter", "then Lucas").replace("does Susan", "does Nora")


def found(spark, table, docs, items):
    bench = spark.createDataFrame([(*i, 1, "?") for i in items], "item_id long, text string, m int, h string")
    return {(r["doc_id"], r["item_id"]) for r in templates.leaks(table(docs), bench).collect()}


def test_marks_and_values(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Then Ann ran 3.5 km, and Bob 2 km; Cy's 1,000 things!",)], "t string")
    words = df.select(templates.marked_words(F.col("t")).alias("w")).first()["w"]
    n, d, u = templates.NAME, templates.NUMBER, templates.UNIT
    assert words == ["then", n + "ann", "ran", d + "3.5", u + "km", "and", n + "bob", d + "2", u + "km", n + "cys", d + "1,000", "things"]


def test_exact_and_reparameterised_copies(spark, table):
    docs = [
        (1, f"Some words before. {ITEM} And some after."),
        (2, f"Other words in front, {REWORDED}"),
        (3, "Nothing of the kind is here, only words that no item has, twelve or more of them."),
        (4, ITEM.split(". ")[0].replace("of apples", "of very sweet apples")),
        (5, None), (6, ""), (None, ITEM), (1, "the same id with a clean text"),
    ]
    assert found(spark, table, docs, [(7, ITEM)]) == {(1, 7), (2, 7), (4, 7), (None, 7)}


def test_inconsistent_slots_are_no_copy(spark, table):
    assert found(spark, table, [(1, CLASHING_VALUES)], [(7, ITEM)]) == set()


TWO_FIVES = (
    "Every morning before the market opens the old baker puts 5 apples on the long table and "
    "later in the day he shares all of them in equal parts among 5 friends who have come to help."
)


def test_one_clashing_value_loses_only_its_windows(spark, table):
    docs = [
        (1, ITEM.replace("does Mary", "does Nora")),
        (2, TWO_FIVES.replace("5 apples", "7 apples").replace("5 friends", "3 friends")),
        (3, REWORDED + " And then Peter left."),
        (4, CLASHING_VALUES),
    ]
    assert found(spark, table, docs, [(7, ITEM), (8, TWO_FIVES)]) == {(1, 7), (2, 8), (3, 7)}


def test_majority_binding_and_verbatim_windows_are_counted(spark, table):
    n = [f"word{i} of{i} the{i} text{i} then{i}" for i in range(6)]
    item = " ".join(f"{w} 5" for w in n)
    edited = " ".join(f"{w} {v}" for w, v in zip(n, "777739"))
    half = " ".join(f"{w} {v}" for w, v in zip(n, "555379"))
    late = " ".join(f"{w} {v}" for w, v in zip(n, "557777"))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["windows"], r["slots"]) for r in templates.leaks(table([(1, edited), (2, half), (3, late)]), bench).collect()}
    # 36 words, 29 windows; values at 6, 12, ..., 36: windows free of the stray places, and verbatim ones
    assert got == {1: (22, 1), 2: (16, 1), 3: (27, 2)}


def test_short_empty_and_repeated_items(spark, table):
    items = [(1, "tiny item here"), (2, None), (3, ""), (4, ITEM), (4, ITEM), (None, ITEM), (5, "$$ !!")]
    docs = [(10, "a tiny item here, in a text"), (11, "tiny item there"), (12, ITEM), (12, ITEM)]
    assert found(spark, table, docs, items) == {(10, 1), (12, 4)}
    assert found(spark, table, docs, []) == set()
    assert found(spark, table, [], items) == set()


def test_without_leaks_keeps_columns_and_rows(spark, table):
    docs = table([(1, ITEM), (1, "clean"), (2, "clean too"), (None, None)])
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    kept = templates.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, "clean"), (2, "clean too"), (None, None)}


TOM = "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have now? Tom eats 2 of them."


def test_names_at_the_start_of_a_sentence(spark, table):
    docs = [
        (1, TOM), (2, TOM.replace("Tom", "Anna")), (3, TOM.replace("Tom", "Anna").replace("5", "9")),
        (4, "First: " + TOM.replace("Tom", "Émile").replace("3", "12")),
        (5, "Tom has apples. They buy more of them. How many do we have? He eats some."),
        (6, TOM.replace("Tom has", "Anna has").replace("Tom buys", "Peter buys").replace("does Tom", "does Nora").replace("Tom eats", "Paul eats")),
    ]
    assert found(spark, table, docs, [(7, TOM)]) == {(1, 7), (2, 7), (3, 7), (4, 7)}


def test_short_items_are_listed_not_judged(spark, table):
    bench = spark.createDataFrame([(1, "yes"), (2, "Is it 5 km?"), (3, "one of them is"), (None, ITEM), (4, None)], "item_id long, text string")
    assert {r["item_id"] for r in templates.unjudged_items(bench).collect()} == {1, 2, None, 4}
    docs = [(1, "The council says yes to it."), (2, "is it 7 km away"), (3, "Here one of them is.")]
    assert {(r["doc_id"], r["item_id"]) for r in templates.leaks(table(docs), bench).collect()} == {(3, 3)}


def test_recall_on_planted_reparameterised_copies(spark, table):
    """Benchmark items of the driver with every name and number changed consistently."""
    import re
    from pathlib import Path

    import pytest

    path = "/root/testdata/sf0.01/benchmark.parquet"
    if not Path(path).exists():
        pytest.skip("no driver tables")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(path).collect()]
    inner = re.compile(r"(?<=[^\W\d_A-Z] )([A-ZÀ-Ý][^\W\d_]+)")
    docs = []
    for item_id, text in items:
        for name in set(inner.findall(text)):
            text = re.sub(rf"\b{name}\b", "Q" + name.lower()[::-1], text)
        docs.append((item_id, "Before it. " + re.sub(r"\d+", lambda m: str(int(m[0]) + 1), text) + " After it."))
    got = found(spark, table, docs, items)
    assert sum((d, d) in got for d, _ in docs) >= 0.9 * len(docs)
