"""Fill-in-the-middle against a plain regular-expression version, and exact round trips."""

import hashlib
import itertools
import random
import re

import pytest

from ledgerline.llm import infill
from pyspark.sql import functions as F

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
CLASHES = "n form prefix_chars middle_chars output k h1 ends".split()
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES)


def plain_version(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<P>|<S>|<M>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rnd = random.Random(5)
    parts = ["a", "Wörter", " ", "\n\n", "\t", "\x0b\x0c", " ", " ", "<", "<S", "P>", "<<", "𝔘", "é", "\x00", "<P >"]
    out = [None, "", " ", "\r\n ", "x", " x", "x ", "a<P>b", "<M>", "<S>x", "é" * 70_000 + " end\n", "word " * 50_000]
    return out + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]


def test_equals_plain_version_and_round_trips(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "null key here"), (None, "null key here"), (3, "again 3"), (3, "again 3")]
    df = spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], SCHEMA)
    out = infill.fill_in_middle(df).select("*", infill.restored(F.col("form"), F.col("output")).alias("back"))
    got = sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect())))
    assert got == sorted(map(repr, ((k, *plain_version(k, t), t or "") for k, t in rows)))
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_every_pair_of_cuts_is_restored(spark):
    """All cuts of a text whose pieces look like halves of markers, in both forms, by any key's draws."""
    rows = [(k, "<<S P><M <P <S> >".replace("<S>", "<S >")) for k in range(600)]
    how = infill.Infill(rate=100, suffix_first=50)
    out = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), how=how)
    out = out.select("*", infill.restored(F.col("form"), F.col("output"), how).alias("back")).collect()
    assert {r.back for r in out} == {rows[0][1]} and {r.form for r in out} == {"psm", "spm"}
    n = out[0].n
    assert len({(r.prefix_chars, r.middle_chars) for r in out}) == (n + 1) * (n + 2) // 2  # every cut was met


def test_empty_tables_and_settings(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("k1", "one two three")], "doc_id string, text string")
    assert infill.fill_in_middle(df, how=infill.Infill(rate=0)).first().form == "plain"
    assert infill.fill_in_middle(df, how=infill.Infill(rate=100, suffix_first=0)).first().form == "psm"
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P<>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.Infill(markers=bad)
    with pytest.raises(ValueError):
        infill.Infill(rate=101)


def test_tokens_cover_texts():
    for t in itertools.chain(texts()[1:], ["", "   "]):
        import numpy as np

        points = np.frombuffer((t or "").encode("utf-32-le"), "<u4")
        assert list(infill.token_ends(points)) == [m.end() for m in TOKEN.finditer(t or "")]
