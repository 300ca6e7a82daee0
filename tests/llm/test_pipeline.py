"""The pipeline stage by stage on a small table, and the registered queries."""

import random
from collections import Counter

import corpus_pipeline
import __spark_entry__ as contract
from tagloom.llm import balancing, pii, toxicity
from tagloom.llm.queries import QUERIES


def test_every_operator_is_registered():
    numbers = {name.split("_")[0] for name in QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


def test_stages_keep_the_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        assert before * 0.7 < docs.count() <= before, name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    per_copy = mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert per_copy <= 2
    words = mixed.agg({"size": "sum"}).first()[0]
    once = mixed.select("source", "target").distinct().agg({"target": "sum"}).first()[0]
    assert abs(words - once) < 0.1 * once


def test_run_equals_plain_stages(spark, tmp_path):
    """All rows of ``run()`` against plain Python on its own tables, stage after stage.

    What the models say of a text is taken from the operators; what the stages make of it is not.
    """
    rng = random.Random(11)
    words = [f"word{i}" for i in range(300)]

    def sentence(n):
        return " ".join(rng.choices(words, k=n))

    items = [sentence(14) for _ in range(3)]
    base = [sentence(60) for _ in range(40)]
    texts = list(base)
    texts += [base[i] for i in range(5)]  # exact copies
    texts += [" ".join([*base[i].split()[:-1], "changed"]) for i in range(5, 10)]  # near copies
    texts += [f"{sentence(30)} {items[0]} {sentence(20)}", f"{sentence(30)} {items[1]}".replace("word", "WORD")]
    texts += [f"write to jane{i}@mail.example.org or call +44 20 7946 09{i}{i} {sentence(40)}" for i in range(5)]
    texts += [f"you idiot scum {sentence(30)} idiot" for _ in range(8)] + [None, "", "one two"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    toxic_ids = {i for i, t in enumerate(texts) if t and "idiot" in t}
    labels = spark.createDataFrame([(i, 1, int(i in toxic_ids)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    sf_dir = str(tmp_path)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    labels.write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")

    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    left = {r[0]: r for r in rows if not scored[r[0]]}

    def shingles(text):
        tokens = (text or "").lower().split()
        return {tuple(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set()

    sets = {i: shingles(r[1]) for i, r in left.items()}
    parent = {i: i for i in left}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in left:
        for b in left:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    left = {i: r for i, r in left.items() if root(i) == i}

    def leaks(text):
        tokens = (text or "").lower().split()
        for item in items:
            item = item.split()
            row = [0] * (len(tokens) + 1)
            for k, word in enumerate(item):
                new = [k + 1]
                for j, token in enumerate(tokens):
                    new.append(min(row[j] + (word != token), row[j + 1] + 1, new[j] + 1))
                row = new
            if min(row) <= int(0.2 * len(item)):
                return True
        return False

    left = {i: r for i, r in left.items() if not leaks(r[1])}
    assert len(left) < len(texts) - 8 - 10 - 2 + 1 and {0, 20} <= set(left)
    kept = spark.createDataFrame(list(left.values()), docs.schema)
    spans = {r.doc_id: r.spans for r in pii.find(kept).collect()}
    kinds = ["email", "ip", "card", "phone"]
    for i, r in left.items():
        found = [s.split(":") for s in (spans[i] or "").split(",") if s]
        found = [(kinds.index(k), int(a), int(b)) for k, a, b in found]
        text = r[1]
        for kind, start, end in sorted(found, key=lambda x: -x[1]):
            text = f"{text[:start]}[{kinds[kind].upper()}]{text[end:]}"
        left[i] = (*r[:1], text, *r[2:4], len(text) if text is not None else None)
    assert sum("[EMAIL]" in (r[1] or "") for r in left.values()) == 5

    got = corpus_pipeline.run(spark, sf_dir).collect()
    mixed = {r.doc_id: r.copies for r in balancing.mixed(spark.createDataFrame(list(left.values()), docs.schema)).collect()}
    expected = Counter({i: n for i, n in mixed.items() if n})
    assert Counter(r.doc_id for r in got) == expected
    for r in got:
        if "text" in r.__fields__:
            assert r.text == left[r.doc_id][1]
        assert r.size == len((left[r.doc_id][1] or "").split()) and r.source == left[r.doc_id][3]


def test_run_on_empty_tables(spark, tmp_path):
    sf_dir = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf_dir).collect() == []
