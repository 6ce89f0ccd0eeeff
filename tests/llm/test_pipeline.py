from __future__ import annotations

import hashlib
import threading
import zlib

import numpy as np
import public_tokenizers
from test_decontaminate import brute
from test_mixing import brute_mix
from test_simhash import brute_classes, brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from tidefold.llm import decontaminate, langid, simhash
from tidefold.llm.common import crc32_mod, cut, made

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().split()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    before, after = seen["language_id"]
    kept = langid.identify(before, langid.fit(before, crc32_mod("doc_id", 3) != 1)).where("not rejected")
    assert ids(after) == ids(kept)
    before, after = seen["near_duplicates"]
    assert ids(after) == sorted({r.component_id for r in simhash.near_duplicates(before).collect()})
    before, after = seen["benchmark_free"]
    assert ids(after) == ids(decontaminate.scan(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit = 0"))
    before, after = seen["mixture"]
    assert set(ids(after)) <= set(ids(before))
    before, after = seen["token_files"]
    assert ids(after) == ids(before) and after.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = after.orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def brute_run(spark, rows, items):
    """The stages one after the other in plain Python; the language model alone is the operator's own."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(docs, crc32_mod("doc_id", 3) != 1)
    kept = [r for r in rows if not model.predict(r[1])[2]]
    fps = [brute_fingerprint(r[1]) for r in kept]
    root, first = brute_classes(fps), {}
    for r, f in zip(kept, fps, strict=True):
        if root[f] not in first or (r[0], r[1] or "") < (first[root[f]][0], first[root[f]][1] or ""):
            first[root[f]] = r
    kept = [r for r in first.values() if not brute(r[1], items)[1]]
    _, target, taken = brute_mix([(r[0], r[1], r[3]) for r in kept])
    sizes, order, copies = {}, {}, []
    for k, r in enumerate(kept):
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
        order.setdefault(r[3], []).append((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], k))
    for s, mine in order.items():
        for p in range(2):
            done = p * sizes[s]
            for *_, k in sorted(mine):
                done += len(words(kept[k][1]))
                copies.append((done / target[s], s is None, s or "", k))
    left, drawn = sum(taken), []
    for *_, k in sorted(copies):
        if left > 0:
            drawn.append(kept[k])
        left -= len(words(kept[k][1]))
    tokenizer, out, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for r in sorted(drawn, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_run_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_run(spark, rows, items))


def test_odd_tables_run_through(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"
    word = "the quick brown fox jumps over the lazy dog and runs on"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "a", 0, "k", "r"), (None, word, "en", None, 1, "k", "r"), (1, word, "en", "a", 2, "k", "r"), (2, word.upper() * 3000, None, "b", 3, "k", "r"), (2, "12 34", "en", "b", 4, "k", "r")] + [(3, word, "en", "a", 5, "k", "r")] * 3
    for name, some in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
        got = corpus_pipeline.run(spark, folder).collect()
        assert (len(got) > 0) == bool(some)


def test_stages_delete_what_the_ones_before_left(spark):
    corpus_pipeline.language_id(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)  # takes away what earlier runs left
    before = set(made(spark))
    corpus_pipeline.run(spark, SF).count()
    assert len(set(made(spark)) - before) == 2  # the stages' results and the token files


def test_operators_beside_a_stage_keep_their_tables(spark):
    """A stage runs while another operator of the session makes a table, in its thread between stages and in another one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.language_id(spark, docs, SF)
    beside = cut(docs.select("doc_id"), "beside")
    made_by_other = []
    started, end = threading.Event(), threading.Event()

    def other():
        started.wait(60)
        made_by_other.append(cut(docs.select("text"), "other"))
        end.set()

    thread = threading.Thread(target=other)
    thread.start()

    def slow(*args):
        started.set()
        end.wait(60)
        return args[1]

    corpus_pipeline._stage(slow)(spark, docs, SF)
    thread.join()
    corpus_pipeline.near_duplicates(spark, docs, SF)
    assert beside.count() == made_by_other[0].count() == docs.count()
