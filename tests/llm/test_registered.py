"""The registered queries against their SQL, where there is some, and the pipeline against its stages."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scoreloom.llm import decontaminate, jaccard, shards
from scoreloom.llm.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected = duck_rows(sf_dir, ORACLES[name])
    assert columns == expected_columns and len(rows) == len(expected) and rows == expected


def test_sharding_matches_sql(spark, sf_dir):
    """All but the checksum, which SQL lacks."""
    got = QUERIES["op8_sharding"](spark, sf_dir)
    assert spark_rows(got.drop("text_crc32")) == duck_rows(sf_dir, shards.oracle())
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id: r.text_crc32 for r in got.collect()} == {r.doc_id: zlib.crc32((r.text or "").encode()) for r in texts}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and 0 < kept.count() < docs.count(), name
        assert kept.exceptAll(docs).isEmpty()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    near = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).select("doc_id").collect()}
    groups = jaccard.jaccard_components(docs, 5, 80).where("doc_id <> component_id").collect()
    assert near == ids - {r.doc_id for r in groups}
    clean = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, sf_dir).select("doc_id").collect()}
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert clean == ids - {r.doc_id for r in leaks.collect()}
    last = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids"} <= set(last.columns) and last.where(F.size("ids") != F.col("n_tokens")).isEmpty()
    assert {r.doc_id for r in last.select("doc_id").collect()} <= near & clean


def _tables(spark, folder, documents, benchmark, labels):
    schemas = {
        "documents": (documents, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": (benchmark, "item_id long, text string"), "labels": (labels, "doc_id long, quality int, toxic int"),
    }
    for name, (rows, schema) in schemas.items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, blank texts, repeated rows, ties and missing identifiers, stage by stage against plain Python."""
    from test_operators import SPACES, edited, prose, smith_waterman, split_words

    item = prose(5000, 24)
    texts = {i: prose(i, 40) for i in range(120)} | {200 + i: f"you idiot {prose(200 + i, 30)}" for i in range(60)}
    texts |= {9: prose(9, 100), 300: texts[3].replace(" ", "\n"), 301: texts[3] + " ", 302: texts[4], 310: edited(prose(9, 100), [20]), 311: f"{prose(700, 30)} {item} {prose(701, 30)}",
              312: f"{prose(702, 30)} {edited(item, [5, 11])} {prose(703, 30)}", 320: None, 321: "", 322: " \n"}
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in texts.items()]
    rows += [(302, texts[302], None, None, None), (None, prose(800, 40), "en", "s", 1), (None, None, None, None, None)]
    labels = [(i, None, int(i >= 200)) for i in texts if i < 290] + [(None, 1, 1), (5000, 0, None)]
    folder = _tables(spark, tmp_path, rows, [(1, item), (2, None), (None, prose(0, 40))], labels)

    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs.sparkSession.catalog.clearCache()
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        docs = seen[name]
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    given = Counter((i, t) for i, t, *_ in rows)

    scored = pairs(seen["toxicity"])
    clean = Counter({k: n for k, n in given.items() if k[0] is None or not 200 <= k[0] < 290})
    assert not clean - scored and sum(scored.values()) < sum(given.values())  # clean ones stay, toxic ones go

    groups = {}
    for (i, t), n in scored.items():
        groups.setdefault(SPACES.sub("", t or ""), []).extend([(-len(t or ""), i is None, i or 0, i, t)] * n)
    exact = Counter(tuple(sorted(g, key=lambda x: x[:3])[0][3:]) for g in groups.values())
    assert pairs(seen["exact_dedup"]) == exact

    lowered = [(i, t, split_words(t)) for (i, t), n in exact.items() for _ in range(n)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for _, _, w in lowered]
    gone = set()
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                gone.add(max((lowered[a][0], a), (lowered[b][0], b))[1])
    near = Counter((i, t) for k, (i, t, _) in enumerate(lowered) if k not in gone)
    assert pairs(seen["near_dedup"]) == near and (310, texts[310]) not in near

    words_ = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    kept = Counter({k: n for k, n in near.items() if smith_waterman(words_(item), words_(k[1])) < 0.5})
    assert pairs(seen["decontamination"]) == kept and (311, texts[311]) not in kept and (312, texts[312]) not in kept

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple(tokens.encode(t or "", add_special_tokens=False).ids)) for (i, t), n in kept.items() for _ in range(n))
    assert Counter((r.doc_id, tuple(r.ids)) for r in seen["bpe"].collect()) == want


def test_pipeline_of_no_documents(spark, tmp_path):
    folder = _tables(spark, tmp_path, [], [(1, "one two three four five")], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
