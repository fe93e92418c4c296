"""The pipeline, stage by stage, against brute force over what the stage before kept."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import check_packing, fingerprint_by_hand, lines_by_hand, prose, removed_by_hand, union

import corpus_pipeline
from quern.llm import common, op3_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    texts = ["\n".join(prose(6, 100 + k, 60)) for k in range(260)]
    passage = " ".join(prose(12, 7, 60))[:900]
    texts += texts[:12]  # exact copies
    texts += [t.replace(" ", "  ", 1) + " tail" for t in texts[20:30]]  # near copies
    texts += [f"{prose(1, 300 + k)[0]} {passage} {prose(1, 400 + k)[0]}" for k in range(8)]
    texts += [" ".join(f"{w}&&&" for w in t.split()) for t in texts[40:60]]  # junk
    texts += [None, "", "too short", "again " * 60]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_stages(spark, corpus, tmp_path):
    spark.createDataFrame(corpus, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame.collect()
        made = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert made.columns == frame.columns
            made.coalesce(1).write.parquet(str(tmp_path / f"stage{k}"))
            frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        after = frame.collect() if k < 4 else made.collect()
        kept = {r["doc_id"]: r["text"] for r in after} if k < 4 else {}
        if name == "quality rules":
            gone = {r["doc_id"] for r in before} - set(kept)
            assert gone == {r["doc_id"] for r in before if not r["text"] or "&&&" in r["text"] or r["text"].startswith(("too short", "again"))} | {r["doc_id"] for r in before if r["text"] and len(r["text"].split()) < 10}
            assert all(kept[r["doc_id"]] == r["text"] for r in before if r["doc_id"] in kept)
        elif name == "line dedup":
            places = lines_by_hand([r["text"] for r in before], 0.8)
            for row, r in enumerate(before):
                lines = r["text"].split("\n")
                assert kept[r["doc_id"]] == "\n".join(x for p, x in enumerate(lines) if not x.encode().split() or (row, p) in places)
        elif name == "SimHash near-dedup":
            prints = [fingerprint_by_hand(r["text"]) for r in before]
            pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
            assert set(kept) == {before[root]["doc_id"] for root in set(union(len(prints), pairs))}
        elif name == "suffix-array dedup":
            want = removed_by_hand([r["text"] for r in before], corpus_pipeline.PASSAGE)
            assert sum(w[1] for w in want) > 0
            for r, (_, _, _, left) in zip(before, want, strict=True):
                assert abs(len(kept[r["doc_id"]].encode()) - len(left)) <= 12  # whole characters only
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        else:
            encoder = op3_packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
            ids_of = {r["doc_id"]: [*np.frombuffer(encoder.encode(r["text"]), "<u4").tolist(), 0] for r in before}
            n = check_packing(after, ids_of, 2048)
            assert n <= -(-sum(map(len, ids_of.values())) // 2048) + 1


def test_run_and_empty(spark, corpus, tmp_path):
    spark.createDataFrame(corpus[:40], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    frame = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        frame = common.checkpointed(stage(spark, frame, str(tmp_path)))
        assert frame.where(F.lit(True)).collect() == []


def test_stages_pass_columns_of_any_name_through(spark, corpus, tmp_path):
    rows = [(*r[:4], f"own {r[0]}", "kept") for r in corpus[:60]]
    names = [("__rid", "string"), ("__kept", "string")]
    frame = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, " + ", ".join(map(" ".join, names)))
    frame = common.written(frame.coalesce(1))
    for _, stage in corpus_pipeline.STAGES[:4]:
        made = common.written(stage(spark, frame, str(tmp_path)))
        assert made.columns == frame.columns
        assert all(r["__rid"] == f"own {r['doc_id']}" and r["__kept"] == "kept" for r in made.collect())
        frame = made
