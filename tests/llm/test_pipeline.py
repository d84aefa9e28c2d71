"""Each stage of the pipeline on its own input, against what was planted, and the whole run."""

import random

import pytest

import corpus_pipeline
from loomline.session import ship_package

R = random.Random(21)
EN = "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood everyone has the right to life liberty and security of person".split()
DE = "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geiste der brüderlichkeit begegnen jeder hat das recht auf leben freiheit und sicherheit der person".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns of a table, with names that the operators use themselves.
CLASHING = ("lang_pred", "score", "margin", "row_key", "live_spans", "component_id", "k1", "bad_key", "size", "target")


def prose(words, n=70):
    return " ".join(R.choices(words, k=n))


ITEM = prose(EN, 40)
CLEAN = [(i, prose(EN if i % 3 else DE), "en" if i % 3 else "de", ["a", "a", "b", None][i % 4]) for i in range(60)]
COPIES = [(100, CLEAN[1][1], "en", "a"), (101, CLEAN[2][1] + " person", "en", "b")]
LEAKED = [(200, prose(EN, 30) + " " + ITEM + " " + prose(EN, 30), "en", "a")]
SECRET = [(300, prose(EN) + " password = hunter2hunter2 " + prose(EN, 10), "en", "b")]
UNKNOWN = [(400, "".join(R.choices("abcdefghijklmnopqrstuvwxyz    ", k=2000)), None, "a"), (401, "123 456", None, "a"), (402, None, None, "b"), (403, "", "en", None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    ship_package(spark)
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in CLEAN + COPIES + LEAKED + SECRET + UNKNOWN]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every, gone = [r.doc_id for r in docs.collect()], {}
    for name, lost in (("language ID", {x[0] for x in UNKNOWN}), ("near-dedup", {100, 101}), ("decontamination", {200})):
        left = stage(name)(spark, docs, folder)
        assert left.columns == docs.columns
        gone[name] = set(every) - set(ids(left))
        assert gone[name] == lost, name
    masked = {r.doc_id: r for r in stage("secret scan")(spark, docs, folder).collect()}
    assert sorted(masked) == sorted(every)
    for r in docs.collect():
        if r.doc_id == 300:
            assert "hunter2" not in masked[300].text and "[SECRET]" in masked[300].text and masked[300].n_chars == len(masked[300].text)
        else:
            assert masked[r.doc_id] == r


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {x[0] for x in CLEAN + SECRET}
    sizes = {r.source: r.source_size for r in got}
    assert {r.doc_id for r in got} <= kept and sum(sizes.values()) == sum(len(x[1].split()) for x in CLEAN) + len("x " * 81) // 2
    taken = {}
    for r in got:
        assert 0 < r.taken <= 3 * r["size"] and r.taken % r["size"] == 0
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 40


def test_clashing_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in CLASHING:
        docs = docs.withColumn(c, docs["doc_id"])
    for name, f in corpus_pipeline.STAGES:
        left = f(spark, docs, folder)
        assert left.count() > 0 and (name == "mixture" or left.columns == docs.columns), name
        assert f(spark, docs.limit(0), folder).count() == 0, name
