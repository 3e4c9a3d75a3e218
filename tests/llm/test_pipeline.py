"""The five stages of the pipeline against brute force, on a small table with repeated rows, null ids, toxic rows and near copies."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from depweave.llm import bpe, mixing, toxicity
from depweave.llm._common import utf8

from .test_operators import near_classes_by_brute_force

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


def planted():
    long = {x: " ".join(f"{x}{k}" for k in range(150)) for x in "pqrst"}
    rows = [(5001, long["p"], "en", "web")] * 3 + [(None, long["q"], "en", "web")] * 2 + [(5002, long["r"], "en", "books"), (5002, long["s"], "de", "books"), (5009, long["r"].upper(), "en", "web")]
    rows += [(5003 + k, long["t"].replace(f"t{40 + 9 * k} ", f"changed{k} "), "en", "web") for k in range(3)] + [(None, long["t"], "en", "web"), (5020, None, "en", "web"), (None, "", None, None)]
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that go into each stage, and what the last gives."""
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns).collect()
    assert len(toxic) > 5
    extra = spark.createDataFrame([*planted(), *[tuple(r) for r in toxic], *[(None, *tuple(r)[1:]) for r in toxic]], SCHEMA)
    docs.union(extra).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], str(folder)).write.parquet(f"{folder}/stage{k}")
        frames.append(spark.read.parquet(f"{folder}/stage{k}"))
    return str(folder), frames


def rows(frame):
    return [tuple(r) for r in frame.select("doc_id", "text", "lang", "source").collect()]


def norm(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_toxic_rows_go(spark, stages):
    folder, frames = stages
    model = toxicity.fit(frames[0].select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    given = rows(frames[0])
    alone = lambda text: model.score(toxicity.features(*utf8(pa.array([text], pa.string())), model.lexicon))[0]
    score = {text: alone(text) for text in {r[1] for r in given}}
    assert Counter(rows(frames[1])) == Counter(r for r in given if score[r[1]] < toxicity.THRESHOLD)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & {r[0] for r in rows(frames[1])}) < len(toxic) / 4


def test_one_of_each_text_stays(stages):
    given, got = rows(stages[1][1]), rows(stages[1][2])
    best = {}
    for doc_id, text, *_ in given:
        best[norm(text)] = max(best.get(norm(text), -1), -1 if doc_id is None else doc_id)
    assert len(given) > len(best)
    assert Counter((norm(r[1]), -1 if r[0] is None else r[0]) for r in got) == Counter(best.items())
    assert not Counter(got) - Counter(given)


def test_one_of_each_class_stays(spark, stages):
    given, got = rows(stages[1][2]), rows(stages[1][3])
    frame = spark.createDataFrame([(k, r[1]) for k, r in enumerate(given)], "doc_id long, text string")
    label = near_classes_by_brute_force(frame)
    groups = {}
    for k, row in enumerate(given):
        groups.setdefault(label[k], []).append(row)
    assert any(len(g) > 1 for g in groups.values())
    least = lambda g: min(np.inf if r[0] is None else r[0] for r in g)
    want = {}
    for g in groups.values():
        for r in g:
            want[r] = g
    assert len(got) == len(groups) and not Counter(got) - Counter(given)
    assert Counter(id(want[r]) for r in got) == Counter(id(g) for g in groups.values())
    assert all((np.inf if r[0] is None else r[0]) == least(want[r]) for r in got)


def test_mixed_as_the_sql_says(stages):
    given, got = rows(stages[1][3]), rows(stages[1][4])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(given, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    want = Counter()
    for doc_id, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.oracle()})").fetchall():
        want[doc_id, size] += taken // size if size else 0
    assert Counter((r[0], len((r[1] or "").split())) for r in got) == +want
    assert set(got) <= set(given)


def test_encoded_as_the_library_says(stages):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for doc_id, text, *_ in rows(stages[1][4]):
        ids = known.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), sha(" ".join(map(str, ids))), sha(known.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in stages[1][5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_run_is_the_stages_in_order(spark, stages):
    folder, frames = stages
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, frames[5].collect()))
