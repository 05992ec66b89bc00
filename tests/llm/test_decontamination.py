"""Template canonicalisation on crafted questions, and landed ones by brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F

from concordia.llm.decontamination import contaminations, op3_benchmark_decontamination

QUESTION = ("On a sunny day Alice bought 12 red apples and Bob bought 5 green pears at the market in town, "
            "and later Alice gave 12 of them to Bob before walking 3 km home.")
AGAIN = ("On a sunny day Carol bought 40 red apples and Dave bought 9 green pears at the market in town, "
         "and later Carol gave 40 of them to Dave before walking 8 miles home.")
MIXED = ("On a sunny day Carol bought 40 red apples and Dave bought 9 green pears at the market in town, "
         "and later Erin gave 77 of them to Frank before walking 8 miles home.")
OTHER = "nothing of the kind is written here and this text goes on for some words without any question in it at all"


@pytest.fixture()
def found(spark, scratch, documents):
    def run(texts, items):
        bench = spark.createDataFrame(items, "item_id long, text string")
        return {(r["key"], r["item_id"]): r["reparameterised"]
                for r in contaminations(documents(texts), bench, scratch).collect()}
    return run


def test_exact_and_reparameterised(found):
    got = found([f"{OTHER} {QUESTION} {OTHER}", f"{OTHER}. {AGAIN}", OTHER, None, "", QUESTION.lower()],
                [(1, QUESTION), (2, "a much too short"), (3, None)])
    assert got[0, 1] is False and got[1, 1] is True
    assert set(got) <= {(0, 1), (1, 1), (5, 1)}


def test_inconsistent_slots_are_not_a_match(found):
    assert found([MIXED], [(1, QUESTION)]) == {}


def test_short_item_repeated_rows_and_missing_ids(found):
    short = "which river runs through paris"
    got = found([(4, f"{OTHER} {short} {OTHER}"), (4, OTHER), (None, short)], [(1, short), (1, short), (None, OTHER)])
    assert len(got) == 2 and (4, 1) in got


def test_empty_tables(found):
    assert found([], [(1, QUESTION)]) == {} and found([QUESTION], []) == {}


def test_landed_passages(spark, landed, documents):
    sf = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    bench = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    want = {(d, i) for d, t in docs for i, own in bench if " ".join(own.split()) in " ".join((t or "").split())}
    folder = landed(documents=documents(docs).withColumn("item_id", F.lit(0)),
                    benchmark=spark.createDataFrame(bench, "item_id long, text string"))
    got = op3_benchmark_decontamination(spark, folder).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want


def test_items_of_numbers_and_names_are_found_word_for_word(found):
    sums = "12 + 30 42 | 15 + 20 35 | 7 + 8 15 | 4 + 9 13"
    names = "who met Alice Bob Carol Dave Erin Frank Grace Heidi"
    got = found([f"{OTHER} {sums} {OTHER}", "11 + 30 41 | 16 + 20 36 | 5 + 8 13 | 2 + 9 11",
                 f"so {names} {OTHER}"], [(1, sums), (2, names)])
    assert set(got) == {(0, 1), (2, 2)} and not any(got.values())


def test_short_items_are_found_whole(found):
    got = found([f"{OTHER}.\n2 + 2 = ?\n{OTHER}", f"{OTHER}. Name the capital! {OTHER}", "I cannot name the capital of it", "Yes"],
                [(1, "2 + 2 = ?"), (2, "name the capital"), (3, "yes")])
    assert set(got) == {(0, 1), (1, 2), (3, 3)}


def test_scripts_without_spaces(found):
    item = "中国的首都是哪一座城市"
    got = found([f"今天天气很好我们去公园{item}请回答这个问题", "今天天气很好我们去公园请回答这个问题", f"前文\n法国\n后文"],
                [(1, item), (2, "法国")])
    assert set(got) == {(0, 1), (2, 2)}


def test_a_short_item_on_a_line_of_any_length(found):
    """Few words are a short item however many characters they have; white space counts nothing."""
    item = f"{'x' * 6000} end mark"
    got = found([f"{OTHER}.\n{item}\n{OTHER}", f"{OTHER}.\n{' ' * 9000}name the{' ' * 9000}capital\n", f"{'y' * 6000} end mark"],
                [(1, item), (2, "name the capital")])
    assert set(got) == {(0, 1), (1, 2)}
