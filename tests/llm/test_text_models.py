"""BPE against the tokenizers library, fingerprints, HTML, language, toxicity, quality and chats on small cases."""

import hashlib
import random

import numpy as np
import pytest

from ledgerline.llm import bpe, chat, html_text, language, minhash, quality, toxicity
from tests_support import toxic_docs


def docs(spark, texts, **more):
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe_equals_the_library(tokenizer):
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        mine = bpe.BPE(f.read())
    rnd = random.Random(4)
    pool = [*"abc dE'strÉñ\n\t\x1c\x85\xa0ßΣσİ你😀٣½²_-<|>.,", "'s", "'RE", "<|endoftext|>", "<|end", "the ", "ing"]
    texts = ["", "ab" * 3000 + "the" * 2000, *("".join(rnd.choice(pool) for _ in range(rnd.randint(0, 20))) for _ in range(3000))]
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        got = mine.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, t
        assert mine.decode(got) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark, tokenizer):
    texts = [None, "", "Hello  World", "Hello  World"]
    got = {r.doc_id: r for r in bpe.encode(docs(spark, texts), bpe.tokenizer_path()).collect()}
    ids = tokenizer.encode("Hello  World", add_special_tokens=False).ids
    assert got[0].n_tokens == got[1].n_tokens == 0 and list(got[2].ids) == ids and got[2].ids_sha256 == got[3].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(docs(spark, []), bpe.tokenizer_path()).count() == 0


def test_minhash_against_jaccard():
    rng = np.random.default_rng(1)
    fp, errors = minhash.Fingerprinter(), []
    for n in (30, 300, 3000):
        for keep in (0.0, 0.5, 0.8, 1.0):
            a = [f"w{k}" for k in rng.integers(0, 10**6, n)]
            b = [w if k < n * keep else f"v{k}" for k, w in enumerate(a)]
            grams = [{" ".join(x[i : i + 5]) for i in range(n - 4)} for x in (a, b)]
            true = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
            errors.append(fp.likeness(fp.of(fp.words(" ".join(a))), fp.of(fp.words(" ".join(b)))) - true)
    assert max(map(abs, errors)) < 0.12 and abs(np.mean(errors)) < 0.03
    assert (fp.of(fp.words("A b")) == fp.of(fp.words("a B"))).all() and fp.likeness(fp.of(fp.words("")), fp.of(fp.words(None))) == 1


@pytest.mark.parametrize("buckets", [1, 3, 7])
def test_next_documents(spark, buckets):
    texts = [f"t{k} " * (k % 5) + "é" * (k % 3) for k in range(23)] + [None]
    got = {r.doc_id: r for r in minhash.compare_with_next(docs(spark, texts), buckets=buckets).collect()}
    for k, t in enumerate(texts):
        t, nxt = t or "", texts[k - 1] or ""
        half = len(t) // 2
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    assert len(got) == 24 and minhash.compare_with_next(docs(spark, [])).count() == 0
    assert minhash.compare_with_next(docs(spark, ["one only"])).first().near_next == 1.0


@pytest.mark.parametrize("buckets", [1, 4])
def test_next_documents_of_repeated_and_string_keys(spark, buckets):
    """Every row has a next, and following them passes all texts once, whatever the keys' kind."""
    rows = [("k%02d" % (k % 5), f"text number {k} " * 3, 1, 2, "x") for k in range(40)] + [("k01", "same", 1, 2, "x")] * 3 + [(None, "none", 1, 2, "x")]
    d = spark.createDataFrame(rows, "doc_id string, text string, bucket int, copy int, mark string")
    got = minhash.compare_with_next(d, buckets=buckets).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    fp = minhash.Fingerprinter()
    want = sorted(fp.of(fp.words(r[1])).tobytes().hex() for r in rows)
    assert sorted(r.fingerprint for r in got) == want
    assert [r.doc_id for r in got if r.doc_id is None] == [None]


def plain_fingerprint(fp, text):
    """Bins one by one: the least hash of each, and for an empty one that of the first full bin of its order."""
    hashes = [int(h) for h in fp.shingles(fp.words(text))]
    bins = [[h for h in hashes if h >> int(fp.shift) == b] for b in range(fp.bins)]
    least = [min(x) if x else None for x in bins]
    bits = ""
    for b in range(fp.bins):
        v = least[b] if least[b] is not None else next(least[j] for j in fp.order[b] if least[j] is not None)
        bits += format(v % (1 << fp.bits), f"0{fp.bits}b")
    return int(bits, 2).to_bytes(fp.bins * fp.bits // 8, "big").hex()


def test_fingerprints_equal_plain_bins():
    fp, rnd = minhash.Fingerprinter(), random.Random(6)
    for n in (0, 1, 4, 5, 6, 40, 300, 2000):
        text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
        assert fp.of(fp.words(text)).tobytes().hex() == plain_fingerprint(fp, text)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=1>Home</a></nav><div class="cookie-notice"><p>We use cookies, all of them, always.</p></div>
<div id=content><div class=post><h1>Caf&eacute; &amp; co</h1><p><b>First,   line.<br><p>Second <a href=x>link</a> para&nbsp;here, <script>if (a < b) "</p>";</script>with more.</p><div class="ad-box">Buy</div><ul><li>one<li>two</ul>
<form><p>Form, text, here</p></form></div><section id="comments"><p>I disagree, sir, wholly, and at length.</p></section></div><aside><p>Side, side, side</p></aside><footer>Foot</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Café & co\nFirst, line.\nSecond link para here, with more.\none\ntwo"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"
    assert html_text.main_text("<article><p>" + "a, " * 50000 + "</p>").count(",") == 50000
    assert html_text.main_text("<div hidden><p>no</p></div><p>yes</p><!-- <p>c</p> -->") == "yes"


def test_html_names_and_broken_markup():
    text = html_text.main_text
    long = "Words that go on, and on, until there is enough of them to count as an article's own text, surely."
    assert text('<article><p>One here.</p><a title="x>link</a><p>Two here.</p></article>') == "One here.\nlink\nTwo here."
    assert text(f'<article><p>{long}</p><a title="x>link</a> <a href="y">more</a></article>') == f"{long}\nlink more"
    assert text(f'<article><div class="article-header"><h1>Title</h1></div><p>{long}</p></article>') == f"Title\n{long}"
    assert text(f"<article><p>It's <span class=\"share\">shared</span> data, {long}</p></article>") == f"It's shared data, {long}"
    assert text(f'<article><p>{long}</p><div class="related"><a href=1>Other story</a> <a href=2>One more</a></div><div class="share">Share this</div></article>') == long
    assert text(f'<article><p>{long}</p><div class="related"><p>{long}</p></div></article>') == f"{long}\n{long}"
    assert text(f'<div class="header"><h1>Site</h1></div><div><p>{long}</p><p>{long}</p></div><div class="notice"><p>{long}</p></div>') == f"{long}\n{long}"
    assert text(f'<article><p data-x="<b>not text</b>">{long}</p></article>') == long


def test_html_deep_pages_take_linear_time():
    import time

    took = []
    for n in (2000, 8000):
        began = time.process_time()
        page = "".join(f"<div><p>Paragraph {k}, which is there.</p>" for k in range(n))
        assert "Paragraph" in html_text.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_html_rows(spark):
    d = spark.createDataFrame([(1, PAGE, "clash", "u"), (1, PAGE, "clash", "u"), (None, None, None, None), (2, "", "clash", "u")], "page_id long, html string, text string, url string")
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in html_text.extract(d).collect())
    want = html_text.main_text(PAGE)
    assert got == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0)]
    assert html_text.extract(d.limit(0)).count() == 0


def test_kneser_ney_sums_to_one():
    m = language.fit({g: c for g, c in (("aab", 3), ("aba", 2), ("baa", 2), ("abb", 1))}, order=3)
    codes = lambda s: np.array([[ord(c) for c in s]], np.uint64)
    for h in ("aa", "ab", "ba"):
        total = sum(np.exp(m.log_probs(codes(h + c))[0]) for c in "ab")
        rest = np.exp(m.log_probs(codes(h + "z"))[0])
        assert abs(total + rest - 1) < 1e-9


def test_language(spark):
    en, fr = "the cat and the dog went with that thing", "le chat et les chiens sont dans la maison que nous"
    rows = [(k, en if k % 2 else fr, "en" if k % 2 else "fr") for k in range(200)] + [(200, None, "en"), (201, "12 !", "en"), (202, en, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(d, language.train(d)).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "fr") and 0 <= got[k].score <= 1 for k in range(200))
    assert got[200].lang_pred == got[201].lang_pred == "und" and got[202].lang_pred == "en"
    assert language.identify(d, language.train(d.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_long_texts_score_as_short_pieces():
    m = language.Identifier(["x"], [language.fit({"abca": 5, "bcab": 5, "cabc": 4, " abc": 1}, 4)], 4)
    t = language.plain("abc" * 50)
    one, n = m.entropies([t])
    both, _ = m.entropies([t, t])
    assert n[0] == len(t) - 1 and np.allclose(both, one[0])


def test_toxicity(spark):
    rows = toxic_docs()
    d = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(9000, None), (9001, ""), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(9000, None)], "doc_id long, toxic int")
    m = toxicity.train(d, labels)
    got = {r.doc_id: r for r in toxicity.classify(d, m).collect()}
    right = np.mean([got[k].predicted == y for k, _, y in rows])
    assert right > 0.98 and got[9000].predicted == got[9001].predicted == 0
    plain, gapped = (m.decide([x])[0] for x in ("vilgrak", "vilxgrak"))
    assert plain > gapped > m.decide(["balori"])[0] and m.highest(["a v i l g r a k b"])[0] > m.decide(["balori"])[0]
    kept = toxicity.keep_clean(d, m)
    assert kept.count() == sum(r.predicted == 0 for r in got.values()) + 1 and kept.columns == d.columns
    assert toxicity.classify(d, toxicity.train(d, labels.limit(0))).where("predicted = 1").count() == 0


def test_spelt_out_insults_in_short_texts():
    bags = [(y, [sorted(toxicity.segments(x)) for x in toxicity.sentences(t)]) for _, t, y in toxic_docs()]
    m = toxicity.fit(bags, [])
    spelt = ["v i l g r a k", "v. i. l. g. r. a. k.", "v, i, l, g, r, a, k", "(v) (i) (l) (g) (r) (a) (k)", "v - i - l - g - r - a - k", "balori V. * I. * L. G. R. -- A. K. sute"]
    assert (m.highest(spelt) >= m.decide(["vilgrak"])[0] - 1e-9).all()
    assert (m.highest(["b. a. l. o. r. i.", "a - b or c", "v i balori l g"]) < 0).all()
    assert toxicity.apart("a. - b, ... c x1y d 5 e".split()) == ["abc"] and toxicity.apart("a - b".split()) == []


def test_kernel_fold_equals_landmark_sum():
    rows, marks = ["hello", "hxello", "abc"], ["hello", "yellow"]
    k = toxicity._kernel(rows, marks)
    assert abs(k[0, 0] - 1) < 1e-9 and k[0, 0] > k[1, 0] > k[2, 0] >= 0


def test_quality(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(600):
        good = k % 2
        w = [rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)]
        rows.append((k, " ".join(w) + "." if good else " | ".join(x.upper() + "!!" for x in w), "en", "s", good))
    d = spark.createDataFrame([r[:4] for r in rows] + [(9000, None, None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(d, quality.train(d, labels)).collect()}
    assert np.mean([got[r[0]].predicted == r[4] for r in rows]) > 0.98 and 0 <= got[9000].score <= 1
    assert quality.classify(d, quality.train(d, labels.limit(0))).count() == 601


def test_chats(spark):
    call = '{"tool_calls":[{"id":"c1","name":"add","arguments":{"b":2,"a":1}},{"id":"c2","name":"add","arguments":{"a":"x"}}],"content":"ok"}'
    rows = [(1, 0, "user", 'say "hi"'), (1, 1, "tool", '{"tool_call_id":"c1","content":"3"}'), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id":"zz","content":"?"}'), (1, 3, "tool", '{"tool_call_id":"zz","content":"?"}'), (2, None, None, None), (None, 0, "user", "a"), (None, 0, "user", "b")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(d, {"add": {"a": ("number", True), "b": ("number", True)}}).collect()
    one = next(r for r in got if r.conv_id == 1)
    assert (one.n_messages, one.n_calls, one.n_invalid, one.n_unlinked) == (4, 2, 1, 2)
    assert one.chat == (
        '[{"content":"say \\"hi\\"","role":"user"},{"content":"ok","role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2},"id":"c1","name":"add"},{"arguments":{"a":"x"},"id":"c2","name":"add"}]},'
        '{"content":"3","role":"tool","tool_call_id":"c1"},{"content":"?","role":"tool","tool_call_id":"zz"}]'
    )
    assert sorted(r.chat for r in got if r.conv_id is None) == ['[{"content":"a","role":"user"}]', '[{"content":"b","role":"user"}]']
    assert one.n_rows == 5
    assert chat.format_chats(d.limit(0)).count() == 0


def test_chat_pieces_are_runs_in_order(spark):
    """A crowd of turns, and one at a single turn: the pieces joined are the conversation as one row would hold it."""
    schema = "conv_id long, turn long, role string, text string, own int, at int, part int, piece int, message int, rows int, j int"
    rows = [(1, k % 40, "user", f"m{k}") for k in range(200)] + [(2, 5, "user", f"crowd {k}") for k in range(300)] + [(2, 6, "user", "last")] + [(3, None, None, "ok")] * 3
    d = spark.createDataFrame([(*r, *[9] * 7) for r in rows], schema)
    import json

    whole = {r.conv_id: json.loads(r.chat) for r in chat.format_chats(d, part_turns=1000, part_messages=10**6).collect()}
    parts = chat.format_chats(d, part_turns=1000, part_messages=50).collect()
    for c in (1, 2, 3):
        mine = sorted((r for r in parts if r.conv_id == c), key=lambda r: r.piece)
        assert [m for r in mine for m in json.loads(r.chat)] == whole[c]
        assert max(r.n_messages for r in mine) < 200 and (c == 3 or len(mine) > 2)
    assert sum(r.n_rows for r in parts) == len(rows) and len(whole[3]) == 1


def plain_chat(turns, schemas):
    """A conversation's JSON by a plain program: calls by identifier, results after them, arguments checked."""
    import json

    seen, calls, said = [], {}, {}
    for turn, role, text in turns:
        try:
            j = json.loads(text) if role in ("assistant", "tool") else None
        except ValueError:
            j = None
        seen.append((turn, role, text, j if isinstance(j, dict) else None))
    for turn, role, _, j in seen:
        for c in (j or {}).get("tool_calls", []) if role == "assistant" else []:
            calls.setdefault(c["id"], turn)
    out, invalid = [], 0
    for turn, role, text, j in seen:
        m, place = {"content": text, "role": role}, (turn, 0, turn)
        if role == "assistant" and j and j.get("tool_calls"):
            m = {"content": j.get("content") or "", "role": role, "tool_calls": [{"arguments": c["arguments"], "id": c["id"], "name": c["name"]} for c in j["tool_calls"]]}
            for c in j["tool_calls"]:
                fields = schemas.get(c["name"])
                kinds = {"number": (int, float), "string": str}
                good = fields is not None and all((f not in c["arguments"] and not need) or (f in c["arguments"] and isinstance(c["arguments"][f], kinds[k])) for f, (k, need) in fields.items())
                invalid += not good
        elif role == "tool" and j and j.get("tool_call_id"):
            m = {"content": j.get("content") or "", "role": role, "tool_call_id": j["tool_call_id"]}
            at = calls.get(j["tool_call_id"])
            if at is not None and j["tool_call_id"] not in said:
                said[j["tool_call_id"]] = 1
                place = (max(at, turn), 1 if at > turn else 0, turn)
        out.append((place, json.dumps(m, sort_keys=True, separators=(",", ":"))))
    return "[" + ",".join(m for _, m in sorted(out, key=lambda x: x[0])) + "]", invalid


def test_chats_equal_a_plain_program(spark):
    import json

    rnd, rows = random.Random(9), []
    schemas = {"add": {"a": ("number", True), "b": ("number", False)}, "find": {"q": ("string", True)}}
    for conv in range(40):
        ids = [f"c{k}" for k in range(6)]
        for turn in range(12):
            kind = rnd.randrange(3)
            if kind == 0:
                calls = [{"id": ids.pop(), "name": rnd.choice(["add", "find", "none"]), "arguments": rnd.choice([{"a": 1}, {"q": "x", "z": 2.5}, {"b": "no"}, {}])} for _ in range(min(len(ids), rnd.randint(1, 2)))]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls, "content": f"t{turn}"}) if calls else "nothing"))
            elif kind == 1:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rnd.randrange(6)}", "content": f"r{turn}"})))
            else:
                rows.append((conv, turn, "user", f'say "{turn}"'))
    got = {r.conv_id: (r.chat, r.n_invalid) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    for conv in range(40):
        assert got[conv] == plain_chat([r[1:] for r in rows if r[0] == conv], schemas), conv


CLASHES = "k y t l s d at held weight calibrates kind n fp text_ known part key lang_pred score predicted".split()


def clashing(spark, rows):
    """doc_id, text, lang, source, and columns of names that the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASHES)
    return spark.createDataFrame([(*r, *[9] * len(CLASHES)) for r in rows], schema)


def test_models_with_clashing_columns_repeats_and_no_rows(spark):
    rows = [(k, t, "en" if k % 2 else "fr", None if k % 5 else "s") for k, t, _ in toxic_docs()[:240]] + [(7, "again", None, None)] * 2 + [(None, None, None, None), (900, "", "en", "s"), (901, "word " * 30_000, "en", "s")]
    d = clashing(spark, rows)
    labels = spark.createDataFrame([(k, y, y, 1) for k, _, y in toxic_docs()[:240]] + [(None, 1, 1, 1), (3, None, None, 1)], "doc_id long, toxic int, quality int, t int")
    m = toxicity.train(d, labels)
    assert toxicity.classify(d, m).count() == len(rows) and toxicity.keep_clean(d, m).columns == d.columns
    v = quality.train(d, labels)
    got = quality.classify(d, v).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    i = language.train(d)
    assert language.identify(d, i).count() == len(rows)
    none = d.limit(0)
    assert toxicity.classify(none, toxicity.train(none, labels)).count() == quality.classify(none, quality.train(none, labels)).count() == language.identify(none, language.train(none)).count() == 0
    assert minhash.compare_with_next(d).count() == len(rows)


def plain_kernel(a, b):
    """Shared subsequences of three letters within SPAN, each weighted by DECAY for every letter that it skips; normalised."""
    import itertools

    def table(s):
        found, s = {}, f"\x02{s}\x03"
        for at in itertools.combinations(range(len(s)), 3):
            if at[2] - at[0] < toxicity.SPAN:
                sub = "".join(s[k] for k in at)
                found[sub] = found.get(sub, 0) + toxicity.DECAY ** (at[2] - at[0] - 2)
        return found

    x, y = table(a), table(b)
    return sum(x[s] * y.get(s, 0) for s in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_kernel_equals_enumerated_subsequences():
    words = ["hello", "hxello", "abc", "yellow", "aaaa", "ab", "mississippi"]
    got = toxicity._kernel(words, words)
    want = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert np.abs(got - want).max() < 1e-5


def test_folded_weights_equal_the_sum_over_landmarks():
    marks, alpha = ["hello", "yellow", "mississippi"], np.array([0.7, -1.2, 0.4])
    of, sub, u = toxicity.features(marks)
    weight = np.bincount(sub, u * (alpha / np.sqrt(np.bincount(of, u * u, len(marks))))[of], 1 << 18)
    rows = ["hxello", "mellow", "abc", "missisipi"]
    want = np.array([[plain_kernel(r, m) for m in marks] for r in rows]) @ alpha + 0.3
    assert np.abs(toxicity.Machine(weight, 0.3, (1.0, 0.0)).decide(rows) - want).max() < 1e-9


def plain_kneser_ney(counts, gram, discount=language.DISCOUNT):
    """log-probability of a gram's last character by the recursive definition, over dictionaries."""
    order, tables = len(gram), [dict(counts)]
    for _ in range(order - 1):
        lower = {}
        for g in tables[0]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        tables.insert(0, lower)

    def p(g):
        t = tables[len(g) - 1]
        same = {x: c for x, c in t.items() if x[:-1] == g[:-1]}
        below = p(g[1:]) if len(g) > 1 else 1 / (len(tables[0]) + 1)
        if not same:
            return below
        total = sum(same.values())
        return max(same.get(g, 0) - discount, 0) / total + discount * len(same) / total * below

    return np.log(p(gram))


def test_kneser_ney_equals_dictionaries():
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcde ") for _ in range(400))
    counts = {}
    for k in range(len(text) - 3):
        counts[text[k : k + 4]] = counts.get(text[k : k + 4], 0) + 1
    m = language.fit(counts, 4)
    grams = [*list(counts)[:60], *("".join(rnd.choice("abcde z") for _ in range(4)) for _ in range(60))]
    got = m.log_probs(np.array([[ord(c) for c in g] for g in grams], np.uint64))
    assert np.abs(got - [plain_kneser_ney(counts, g) for g in grams]).max() < 1e-9


def test_metadata_view_reads_no_text():
    r = quality.Reader
    assert (r.meta(100, "en", "s") == r.meta(100, "en", "s")).all() and (r.meta(100, "en", "s") != r.meta(5000, "fr", "s")).any()
