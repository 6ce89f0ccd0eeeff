from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidefold.llm import queries, tokencounts, tokenfiles, tokens

TEXTS = [
    None, "", "  ", "Hello World", "it's  the DOG's", "don't STOP 1234 5.6", "Éê ñandú ß İstanbul", "中文 mixed", "<|startoftext|> x <|endoftext|>", "a b c", "l'été---***&&&", "x" * 3000,
    "\U0001f600 emoji", "w1 w2\nw3\t", "ﬁne Ǆ", "é combining", "'s 'll '", "a_b-c|d",
]


@pytest.fixture(scope="module")
def library():
    known = {special: Tokenizer.from_file(tokens.vocabulary()) for special in (True, False)}
    for special, t in known.items():
        t.encode_special_tokens = not special

    def encode(text, special=True):
        return known[special].encode(text or "", add_special_tokens=False).ids

    return encode


def test_pieces_give_the_librarys_ids(library):
    rng = random.Random(1)
    alphabet = "aZé'0-_ \n ß中|<>.İ"
    texts = [*TEXTS, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(300))]
    for special in (True, False):
        own = tokens.WordEncoder(tokens.vocabulary(), 4, special)
        for t in texts:
            assert np.frombuffer(own.encode(t or ""), "<u4").tolist() == library(t, special), t


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")


def test_token_files_read_back(spark, library):
    rows = [(i * 7 - 20, t) for i, t in enumerate(TEXTS * 3)] + [(-500, "first"), (1, "twice"), (1, "twice"), (None, "no id")]
    got = sorted(tokenfiles.encode_and_read(frame(spark, rows).repartition(5)).collect(), key=lambda r: r.start)
    start = 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*library(t), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_any_document_alone(spark, library):
    files = tokenfiles.write_token_files(frame(spark, list(enumerate(TEXTS * 20)))).collect()
    n = 0
    for f in sorted(files, key=lambda f: f.part):
        for k in range(0, f.n_documents, 9):
            assert tokenfiles.read_document(spark, f.path, k).tolist() == [*library(TEXTS[(n + k) % len(TEXTS)]), 2]
        n += f.n_documents
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(files[0].path, b"another dictionary")


def test_empty_tables(spark):
    assert tokenfiles.encode_and_read(frame(spark, [])).count() == 0
    assert tokencounts.document_token_counts(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1, 64, 1 << 20])
def test_counts_across_blocks(spark, library, block):
    texts = [t for t in TEXTS if len(t or "") < 100] if block < 64 else TEXTS
    rows = [(i, t) for i, t in enumerate([*texts, *texts])]
    got = tokencounts.document_token_counts(frame(spark, rows).repartition(3), block=block).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, len(library(t, special=False))) for i, t in rows]


def test_query_over_whole_texts(spark, tmp_path, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in queries.op5_token_counts(spark, str(tmp_path)).collect()) == [(i, len(library(t, special=False))) for i, t in rows]
