import random

import plain
import pytest
from pyspark.sql import functions as F
from test_classifiers import WORDS
from test_jaccard import compared, plain_set

import __spark_entry__ as entry
import corpus_pipeline
from corpus_search.llm import bpe, toxicity


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """A folder with documents and labels: toxic ones, near copies, secrets, odd rows and a further column."""
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        lang = rnd.choice(["en", "en", "en", "de", "fr"])
        words = [rnd.choice(WORDS[lang]) + rnd.choice(["", "", "er", "en", "s"]) for _ in range(rnd.choice([20, 90, 200]))]
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            words[rnd.randrange(len(words))] = rnd.choice(["idiot", "stupid", "moron"])
        text = " ".join(words)
        if i % 10 == 3:
            text += f" password={rnd.getrandbits(64):016x} end"
        rows.append((i, text, lang, f"src{i % 3}", len(text), "x"))
        labels.append((i, 1, int(toxic)))
        if i % 12 == 5:  # a near copy and an exact one
            rows.append((1000 + i, text + " more", lang, "src0", len(text) + 5, "x"))
            rows.append((2000 + i, text, lang, "src0", len(text), "x"))
    rows += [(5000, None, "en", None, None, None), (5001, "", None, "src1", 0, "x"), (None, "no id here at all but some words", "en", "src1", 32, "x")]
    root = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


def test_stages_in_turn(spark, inputs, tmp_path):
    root, rows = inputs
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, at = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "secrets", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, root).write.parquet(f"{tmp_path}/{name}")
        docs = at[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "bpe" or docs.columns == columns
    ids = {n: [r[0] for r in d.select("doc_id").collect()] for n, d in at.items()}
    clean = {i for i, *_ in rows if i is None or i >= 5000 or i % 1000 % 6}
    assert not [i for i in ids["toxicity"] if i is not None and i < 5000 and i % 1000 % 6 == 0]
    assert len(clean - set(ids["toxicity"])) <= 2
    # near copies: one row of each group of the stage's own input
    kept = [(r["doc_id"], r["text"]) for r in at["toxicity"].collect()]
    groups, _ = compared(kept)
    assert len(ids["near_copies"]) == len(set(groups))
    assert {i for i, _ in kept if i in ids["near_copies"]} == {min(d for (d, _), g in zip(kept, groups) if g == h and d is not None) for h in groups if any(d is not None for (d, _), g in zip(kept, groups) if g == h)}
    before = {r["doc_id"]: r for r in at["near_copies"].collect()}
    for r in at["secrets"].collect():
        old = before[r["doc_id"]]
        if old["text"] is None or not plain.secrets(old["text"]):
            assert r == old
        else:
            assert not plain.secrets(r["text"]) and "[secret]" in r["text"] and r["n_chars"] == len(r["text"])
    assert sorted(ids["secrets"], key=repr) == sorted(ids["near_copies"], key=repr)
    assert set(ids["mixing"]) == set(ids["secrets"]) and len(ids["mixing"]) >= len(ids["secrets"])
    assert sorted(ids["bpe"], key=repr) == sorted(ids["mixing"], key=repr)
    assert plain_set("") == frozenset()
    lexicon = bpe.build_lexicon(at["mixing"], "text", bpe.default_tokenizer())
    back = at["bpe"].select("doc_id", bpe.decoded(F.col("ids"), lexicon).alias("t")).distinct().collect()
    text = {r["doc_id"]: r["text"] or "" for r in at["mixing"].collect()}
    assert {r["doc_id"]: r["t"] for r in back} == text


def test_registered_and_whole_run(spark, inputs):
    queries = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries if q.startswith("op")}
    assert queries["pipeline"](spark, inputs[0]).columns == ["doc_id", "n_tokens", "ids"]


@pytest.mark.parametrize("kind", ["empty", "null", "few"])
def test_nothing_is_toxic_without_labels_to_learn_from(spark, inputs, tmp_path, kind):
    root, rows = inputs
    labels = {"empty": [], "null": [(i, 1, None) for i in range(240)], "few": [(1, 1, 1), (2, 1, 0), (3, 1, 0)]}[kind]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {r["predicted"] for r in toxicity.classify(docs, model).collect()} == {0}
