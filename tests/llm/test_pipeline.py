"""The pipeline over planted documents, stage by stage, against what was planted."""

import random
from collections import Counter, defaultdict

import corpus_pipeline

SYLLABLES = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "za"]


def make(rng, k):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(3)) for _ in range(k))


def planted(spark, folder):
    rng = random.Random(11)
    item = make(rng, 40)
    docs, labels, kinds = [], [], {}

    def add(kind, text, toxic=None):
        i = len(docs)
        docs.append((i, text, rng.choice(["en", "fr"]), rng.choice(["s0", "s1", "s2"]), len(text)))
        kinds[i] = kind
        if toxic is not None:
            labels.append((i, 1, toxic))
        return i

    clean = [add("clean", make(rng, rng.randint(60, 120)), 0) for _ in range(240)]
    for _ in range(80):
        words = make(rng, rng.randint(60, 120)).split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "grubby"]))
        add("toxic", " ".join(words), 1)
    for i in clean[:20]:
        add("copy", docs[i][1])
        words = docs[i][1].split()
        words[len(words) // 2] = "edited"
        add("copy", " ".join(words))
    for _ in range(10):
        add("leak", make(rng, 50) + " " + " ".join(item.split()[5:30]) + " " + make(rng, 50))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return kinds


def test_stages_act_on_what_was_planted(spark, tmp_path):
    kinds = planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, Counter(kinds.values())
    gone = {"toxicity": "toxic", "near_duplicates": "copy", "decontamination": "leak"}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if name in gone:
            assert docs.columns == columns
            left = Counter(kinds[r.doc_id] for r in docs.select("doc_id").collect())
            assert left[gone[name]] <= 3 and left["clean"] >= 230, (name, left)
        elif name == "mixing":
            assert docs.columns == columns
            assert max(Counter(r.doc_id for r in docs.select("doc_id").collect()).values()) <= 3
    held = defaultdict(int)
    for r in docs.collect():
        held[r.shard] += len(r.text.encode())
        assert r.shard_bytes <= 1_000_000
    assert len(held) >= 1


def test_run_is_the_stages(spark, tmp_path):
    planted(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard"} <= set(got.columns) and got.count() > 0


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
