"""Archives that numpy and zip wrote: whole ones read back equal, broken ones are reported."""

import datetime as dt
import io
import zipfile

import numpy as np
import pytest

from ledgerline.sources import archives, npz, tables

RNG = np.random.default_rng(3)


def save(path, **arrays):
    np.savez_compressed(path, **arrays)


@pytest.fixture
def store(tmp_path):
    d = tmp_path / "emb" / "deep"
    d.mkdir(parents=True)
    v = RNG.normal(size=(3, 4)).astype(np.float32)
    days = np.array(["2020-03-01", "2021-03-02", "2022-03-03"])
    save(tmp_path / "emb" / "NEW.npz", embeddings=v, dates=days, norms=np.linalg.norm(v, axis=1), n_chunks=np.array([2, 5, 1]))
    save(d / "OLD.npz", embeddings=v.astype(np.float64), dates=days)  # without norms and chunks, as older files
    save(d / "NONE.npz", embeddings=np.zeros((0, 4)), dates=np.array([], "<U10"))
    whole = (tmp_path / "emb" / "NEW.npz").read_bytes()
    bad = {
        "cut": whole[: len(whole) // 2], "empty": b"", "text": b"not an archive", "flat": dict(embeddings=v[0], dates=days), "nodates": dict(embeddings=v), "noemb": dict(dates=days),
        "short": dict(embeddings=v, dates=days[:2]), "norms": dict(embeddings=v, dates=days, norms=np.ones(3)), "nan": dict(embeddings=v * np.nan, dates=days), "words": dict(embeddings=days.reshape(3, 1), dates=days),
        "when": dict(embeddings=v, dates=np.array(["soon", "later", "never"])), "pickled": dict(embeddings=np.array([[None, {}]], object), dates=days[:1]), "chunks": dict(embeddings=v, dates=days, n_chunks=np.array([1.5, 2, 3])), "wide": dict(embeddings=RNG.normal(size=(3, 9)), dates=days),
    }
    for name, x in bad.items():
        if isinstance(x, bytes):
            (d / f"{name}.npz").write_bytes(x)
        else:
            save(d / f"{name}.npz", **x)
    flipped = bytearray(whole)
    flipped[len(flipped) // 3] ^= 0xFF
    (d / "flipped.npz").write_bytes(bytes(flipped))
    (d / "notes.txt").write_text("other files aren't read")
    return tmp_path / "emb", v, days, {*bad, "flipped"}


def test_npz_read_back_equal_and_broken_files_reported(spark, store):
    path, v, days, bad = store
    good, broken = npz.read_npz(spark, str(path), "10-K", dim=4)
    got = sorted((r.ticker, str(r.doc_date), r.doc_type, tuple(np.float32(r.embedding)), round(r.norm, 5), r.n_chunks) for r in good.collect())
    stored, made = np.linalg.norm(v, axis=1), np.linalg.norm(v.astype(float), axis=1)  # as the file has them, in single precision
    want = [(t, str(d), "10-K", tuple(x), round(float(n), 5), c) for t, chunks, norm in (("NEW", (2, 5, 1), stored), ("OLD", (1, 1, 1), made)) for d, x, n, c in zip(days, v, norm, chunks)]
    assert got == sorted(want)
    errors = {r.path.rsplit("/", 1)[1].removesuffix(".npz"): r.error for r in broken.collect()}
    assert set(errors) == bad
    for name, part in {"cut": "no readable", "empty": "no readable", "flat": "1 dimensions", "nodates": "lacks dates", "noemb": "lacks embeddings", "short": "dates of shape", "norms": "norms aren't", "nan": "not finite", "words": "no numbers", "when": "isoformat", "pickled": "no readable", "chunks": "no integers", "wide": "9 components"}.items():
        assert part in errors[name], (name, errors[name])


def test_npz_goes_into_the_embedding_store(spark, store, tmp_path):
    good, _ = npz.read_npz(spark, str(store[0]), "10-K", dim=4)
    tables.write_embeddings(good, f"{tmp_path}/store")
    back = tables.read_embeddings(spark, f"{tmp_path}/store", "10k")
    assert back.count() == 6 and {r.ticker for r in tables.tickers_with_embeddings(back).collect()} == {"NEW", "OLD"}
    again = npz.decode_npz(npz.packed(back)).where("error IS NULL")
    assert sorted((str(r.doc_date), tuple(r.embedding)) for r in again.collect()) == sorted((str(r.doc_date), tuple(r.embedding)) for r in back.collect())


FILE = """This file was made on some day, by someone
Missing data are indicated by -99.99, says the text.

,Mkt-RF,SMB , HML,RF
20200102,   0.86,  -0.88, -0.30, 0.006
20200103,  -0.67,   0.36,   n/a, 0.006
20200106,   0.36,  -0.14,  -0.55, 0.006

  Annual Factors: January-December
,Mkt-RF,SMB,HML,RF
2020,  23.66,  13.18, -46.57, 0.45
20210101, 9, 9, 9, 9
"""
WANT = [(dt.date(2020, 1, 2), 0.0086, -0.0088, -0.003, 0.00006), (dt.date(2020, 1, 3), -0.0067, 0.0036, None, 0.00006), (dt.date(2020, 1, 6), 0.0036, -0.0014, -0.0055, 0.00006)]
NAMES = ["Mkt-RF", "SMB", "HML", "RF"]


def close(rows):
    return [tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]


def test_zipped_factor_file_equals_the_plain_one(spark, tmp_path):
    plain, zipped = tmp_path / "f.csv", tmp_path / "f.zip"
    plain.write_bytes(FILE.replace("\n", "\r\n").encode())
    with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.md", "20200101,1,1,1,1")
        z.writestr("daily.CSV", FILE)
    for path in (plain, zipped):
        df = archives.read_factors(spark, str(path), NAMES)
        assert df.columns == ["date", *NAMES] and close(sorted(map(tuple, df.collect()))) == close(WANT)
    assert set(archives.read_factors(spark, str(zipped)).columns) == {"date", *NAMES}
    joined = tables.join_factors(archives.read_factors(spark, str(zipped), NAMES), archives.read_factors(spark, str(plain), ["SMB"]).withColumnRenamed("SMB", "Mom"), "2020-01-03")
    assert joined.count() == 2 and "Mom" in joined.columns


def test_factor_files_that_lack_what_is_asked(spark, tmp_path):
    (tmp_path / "none.csv").write_text("no table here\n1,2,3\n")
    (tmp_path / "one.csv").write_text("a,b\n20200101,5")
    with pytest.raises(ValueError, match="no daily table"):
        archives.read_factors(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="lacks"):
        archives.read_factors(spark, str(tmp_path / "one.csv"), ["c"])
    assert list(map(tuple, archives.read_factors(spark, str(tmp_path / "one.csv")).collect())) == [(dt.date(2020, 1, 1), 0.05)]


def test_long_tables_keep_their_order_without_line_ids(spark, tmp_path):
    """A table of many lines in an archive of several members: each member's own bounds hold."""
    days = [dt.date(1990, 1, 1) + dt.timedelta(k) for k in range(9000)]
    body = lambda f: "head\n,X\n" + "".join(f"{d:%Y%m%d},{f(k)}\n" for k, d in enumerate(days)) + "\nCopyright 1990\n19990101,7\n"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.csv", body(lambda k: k))
        z.writestr("b.txt", body(lambda k: -k))
    (tmp_path / "two.zip").write_bytes(out.getvalue())
    long = archives.daily_tables(archives.read_lines(spark, str(tmp_path / "two.zip")))
    got = {(r.member, r.date): r.value for r in long.collect()}
    assert len(got) == 18_000 and all(abs(got["a.csv", d] - k / 100) < 1e-9 and abs(got["b.txt", d] + k / 100) < 1e-9 for k, d in enumerate(days))
