"""Document embeddings and chunks: made in the task that reads a document, against a plain program."""

import random

import numpy as np

from ledgerline.operators import encode, text

LONG = " ".join(f"Sentence number {k} of Mr. Smith goes on for a while, as U.S. reports do." for k in range(300))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_embeddings_equal_a_plain_program(spark):
    rows = [(1, LONG), (2, "short words"), (3, ""), (4, None), (5, "é \x1c é" * 900), (6, LONG[:4000]), (6, LONG[4000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in encode.embed_documents(docs.repartition(3), ["doc_id"], dim=32, batch=5).collect():
        got.setdefault(r.doc_id, []).append(r)
    encoder = encode.hashing_encoder(32)
    for k in range(1, 7):
        chunks = [c for i, x in rows if i == k and x is not None for c in text.chunk_text(x)]
        want = encoder(chunks).astype(float).mean(axis=0) if chunks else np.zeros(32)
        assert len(got[k]) == (2 if k == 6 else 1)
        for r in got[k]:
            assert r.n_chunks == len(chunks) and np.allclose(r.embedding, want, atol=1e-6) and abs(r.norm - np.linalg.norm(want)) < 1e-6


def test_a_document_travels_as_one_row(spark):
    """Before, each number of each embedding was a row of a shuffle, and all documents were read again for a join."""
    found = plan(encode.embed_documents(spark.createDataFrame([(1, LONG)], "doc_id long, text string"), ["doc_id"], dim=32))
    assert "posexplode" not in found and "Join" not in found and found.count("Exchange hashpartitioning") == 1


def test_chunks_leave_a_task_in_bounded_batches(spark):
    """Before, a task held all chunks of the rows that it was given at once."""
    rows = [(k, LONG * 30) for k in range(4)] + [(9, None), (10, "")]
    c = text.chunks(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    assert "MapInArrow" in plan(c) and "ArrowEvalPython" not in plan(c)
    got = sorted(map(tuple, c.collect()))
    assert got == sorted((k, n, x) for k, t in rows if t is not None for n, x in enumerate(text.chunk_text(t))) and sum(len(x) for _, _, x in got) > 2 * text._CHUNK_CHARS


def test_chunks_of_pieces_are_those_of_the_whole():
    rnd = random.Random(5)
    signs = ["Mr. ", "U.S. ", "A", "b", " ", "\n\n", ".", '."', "! ", "?) ", '. ("', "(A", " Inc.", "word word", "1", "J. ", "x" * 60]
    for k in range(400):
        whole = "".join(rnd.choices(signs, k=rnd.choice([3, 60, 400])))
        cuts = sorted(rnd.randrange(len(whole) + 1) for _ in range(rnd.choice([0, 3, 80])))
        pieces = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]
        assert list(text.chunk_pieces(pieces, 30)) == text.chunk_text(whole, 30), (k, pieces)


def test_documents_in_pieces_are_embedded_as_wholes(spark):
    rows = [(k % 3, k, LONG[k * 500 : (k + 1) * 500]) for k in range(30)] + [(7, 0, None), (8, 0, "short")]
    p = spark.createDataFrame(rows, "doc_id long, k long, text string")
    got = {r.doc_id: r for r in encode.embed_pieces(p.repartition(4), ["doc_id"], ["k"], dim=16, batch=3).collect()}
    whole = spark.createDataFrame([(d, "".join(x or "" for i, _, x in rows if i == d)) for d in (0, 1, 2, 7, 8)], "doc_id long, text string")
    for r in encode.embed_documents(whole, ["doc_id"], dim=16).collect():
        assert got[r.doc_id].n_chunks == r.n_chunks and np.allclose(got[r.doc_id].embedding, r.embedding, atol=1e-6)
