"""All stages on a crafted corpus whose outcome is known."""

import random
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from concordia.llm.packing import default_tokenizer

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "ha", "lo", "mi", "no", "pe") for b in ("ran", "set", "tin", "lor", "mud")]
SHARED = "this line of the page footer stands in very many of the documents"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_pipeline(spark, landed, documents):
    rng = random.Random(3)
    own = {i: prose(rng, rng.randrange(80, 400)) for i in range(40)}
    item = prose(rng, 30)
    rows = {i: t + ("\n" + SHARED if i < 8 else "") for i, t in own.items()}
    rows[50] = own[20]                                             # a copy
    rows[51] = own[21].rsplit(" ", 1)[0] + " other"                # a near copy
    rows[52] = f"{prose(rng, 60)} {item} {prose(rng, 60)}"         # a benchmark passage
    rows[53] = prose(rng, 20)                                      # too short
    rows[54] = ("spam and eggs again " * 50).strip()               # repeats itself
    rows[55] = None
    folder = landed(documents=documents(list(rows.items())),
                    benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(own)

    tokenizer = Tokenizer.from_file(default_tokenizer())
    length, places = defaultdict(int), defaultdict(list)
    for r in got:
        length[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in own.items():
        text = rows[7] if i == 7 else text                         # the largest id keeps the shared line
        assert length[i] == len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    for own_places in places.values():
        at = np.array(sorted(own_places))
        assert at[0, 0] == 0 and (at[1:, 0] == at[:-1].sum(1)).all() and at[-1].sum() <= 2048


def test_stages_but_the_last_return_documents(spark, landed, documents):
    empty = documents([])
    folder = landed(documents=empty, benchmark=spark.createDataFrame([], "item_id long, text string"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() == 0
