"""Tokens, packing, quality, language, toxicity."""

import base64
import hashlib
import io
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF

from kestrelqc.llm import bpe, langid, packing, quality, toxicity
from kestrelqc.llm.pieces import pieces
from kestrelqc.llm.words import Words, chunks

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a's 's\x1c d''s!'s\n\n x", "日本語 text 　 ok", "ß" * 300, "x" * 5000, "<|endoftext|> a", "a\x00b", "１２ ñ́ ’s"]


@pytest.fixture(scope="module")
def texts(duck):
    return [t for (t,) in duck.sql("select text from documents order by doc_id").fetchall()]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_are_the_patterns(texts):
    regex = pytest.importorskip("regex")
    for t in texts[:60] + ODD:
        assert pieces(t) == regex.findall(public_tokenizers.PATTERN, t)


def test_every_code_point_is_the_librarys(library):
    own = bpe.encoder(MULTI)
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    for k in range(0, len(every), 4096):
        text = "".join(f"a{c}b {c} 1{c}2  {c}{c}'s{c}\n" for c in map(chr, every[k : k + 4096]))
        assert own.encode(text) == library.encode_ordinary(text), hex(every[k])


def test_bpe_is_the_librarys(spark, library, texts, duck):
    own = bpe.encoder(MULTI)
    for t in texts[:60] + ODD:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t) and own.decode(ids) == t.encode()
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, MULTI, with_ids=True).collect()}
    for i, t in duck.sql("select doc_id, text from documents").fetchall():
        ids = library.encode_ordinary(t)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_prefix_tables_append_and_splice(library):
    own, rng = bpe.encoder(MULTI), np.random.default_rng(1)
    letters = np.frombuffer("abcdeht \xe9".encode(), np.uint8)
    for _ in range(150):
        data = bytes(rng.choice(letters, rng.integers(0, 60)))
        table = bpe.Prefixes(own, data[:10]).append(data[10:])
        assert table.ids() == own.merged(data)
        a, b = sorted(rng.integers(0, len(data) + 1, 2).tolist())
        new = bytes(rng.choice(letters, rng.integers(0, 6)))
        assert table.splice(a, b, new).ids() == own.merged(data[:a] + new + data[b:])


def test_packing(texts):
    rng = np.random.default_rng(2)
    for bits in (1, 7, 11, 16, 17, 31):
        x = rng.integers(0, 1 << bits, 1000).astype(np.uint32)
        for n in (0, 1, 63, 64, 65, 1000):
            assert (packing.unpack(packing.pack(x[:n], bits), bits, n) == x[:n]).all()
    assert [packing.bits_for(v) for v in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
    f = io.BytesIO()
    w = packing.Writer(f, 17, block=64)
    parts = [rng.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 5, 200, 0, 64, 1)]
    for i, p in enumerate(parts):
        w.add(None if i == 0 else i, p)
    w.close()
    r = packing.Reader(f)
    assert all((r.document(i) == p).all() for i, p in enumerate(parts))
    assert (r.ids(3, 190) == np.concatenate(parts)[3:190]).all()


def test_packed_files(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = packing.library_encoder(path).tokenizer
    rows = [(i, t) for i, t in enumerate(texts[:80] + ODD)] + [(3, "again"), (3, "again"), (500, None), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.read_packed(packing.write_packed(df, path, partitions=3)).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    start, by = 0, {}
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        by.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    expect = {}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        expect.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in expect.items()}
    assert packing.write_packed(df.limit(0), path, partitions=2).count() == 0


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at, covered = {}, set()
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    for v in at.values():
        if len(v) > 1:
            covered |= {k + j for k in v for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(texts):
    every = [*texts, *ODD, "a b c d e f g h a b c d e f g h i", "\n\n\t", "x\n x\nx\n"]
    got = []
    for part in chunks(every, 4000):
        c = quality.base_counts(part, Words.of(part))
        got += zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)
    assert got == [brute_counts(t) for t in every]


def test_quality_scores(spark, duck):
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ratio = quality.fit(df, labels)
    rows = duck.sql("select doc_id, text from documents").fetchall()
    trusted = {i for (i,) in duck.sql("select doc_id from labels group by 1 having min(quality) = 1").fetchall()}
    raw, good = np.zeros(quality.BINS), np.zeros(quality.BINS)
    bins = {}
    for i, t in rows:
        b = t.encode()
        bins[i] = [(int.from_bytes(b[k : k + 4], "big") * 2654435761 % (1 << 32)) >> 16 for k in range(len(b) - 3)]
        for x in bins[i]:
            raw[x] += 1
            good[x] += i in trusted
    p, q = good + 1, raw + 1
    expect = np.log(p / p.sum()) - np.log(q / q.sum())
    assert np.allclose(ratio, expect)
    got = {r["doc_id"]: r for r in quality.judge(df, ratio).collect()}
    for i, t in rows:
        n, _, _, _, repeated = brute_counts(t)
        score = expect[bins[i]].mean() if bins[i] else 0
        assert math.isclose(got[i]["score"], score, abs_tol=1e-6)
        assert got[i]["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["score"] >= quality.MIN_SCORE)
    kept = {r["doc_id"] for r in quality.keep(df, ratio).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}
    assert not quality.fit(df, labels.limit(0)).any()


def test_language_held_out(spark, duck):
    from pyspark.sql import functions as F

    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    out = langid.identified(df, langid.fit(df)).join(df.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert len(out) > 250 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98
    f = langid.fit(df)
    assert langid.predict(f, [b"", b"12 !", "日本".encode()])[0][:2] == ["und", "und"]
    none = langid.fit(df.limit(0))
    assert langid.predict(none, [b"the"])[0] == ["und"]


def test_bloom_rows_hold_what_was_put_in(spark):
    df = spark.createDataFrame([(i, t, lang) for i in range(60) for t, lang in (("alpha beta gamma", "xx"), ("uno dos tres", "yy"))], "doc_id long, text string, lang string")
    f = langid.fit(df)
    assert f.languages == ["xx", "yy"]
    lang, score = langid.predict(f, [b"alpha gamma", b"tres uno", "Beta\tALPHA".encode()])
    assert lang == ["xx", "yy", "xx"] and score.min() > 0.9


def test_filters_and_popcounts_are_brute_forces(spark):
    rng = np.random.default_rng(16)
    letters = [list(rng.choice(list("abcdefghijklmnopqrstuvwxyzéßøж"), 12, replace=False)) for _ in range(5)]
    word = lambda k: "".join(rng.choice(letters[k], int(rng.integers(2, 9))))
    rows = [(i, " ".join(word(i % 5) for _ in range(40)), f"l{i % 5}") for i in range(150)] + [(900, None, "l1"), (901, "x", None), (None, "zzz zzz", "l2")]
    f = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    count = {}
    for i, t, x in rows:
        if i is not None and t and x and zlib.crc32(str(i).encode()) % 3 != 1:
            b = re.sub(rb"[^a-z\x80-\xff]", b" ", b" " + t.lower().encode() + b" ")
            for n in langid.SIZES:
                for k in range(len(b) - n + 1):
                    if b" " not in b[k + 1 : k + n - 1]:
                        g = int.from_bytes(bytes([n]) + b[k : k + n], "big")
                        count.setdefault(x, {}).setdefault(g, 0)
                        count[x][g] += 1
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in count.items()}
    top = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    has = {x: {g for g, n in c.items() if n >= langid.MIN_COUNT and rate[x][g] >= langid.MIN_SHARE * top[g]} for x, c in count.items()}
    bits, table = len(f.rows).bit_length() - 1, np.zeros_like(f.rows)
    for k, x in enumerate(f.languages):
        for g in has[x]:
            for s in langid.slots(np.array([g], np.uint64), bits):
                table[s[0], 0] |= np.uint64(1 << k)
    assert f.languages == sorted(has) and (table == f.rows).all()
    for _, t, _ in rows[:25]:
        g, _ = langid.grams([t.lower().encode()])
        counts = np.array([sum(all(int(f.rows[s[0], 0]) >> k & 1 for s in langid.slots(np.array([x], np.uint64), bits)) for x in g.tolist()) for k in range(5)])
        true = np.maximum(counts - len(g) * f.false_rate, 0) / (1 - f.false_rate)
        lang, score = langid.predict(f, [t.encode()])
        assert lang == [f.languages[int(true.argmax())]] and score[0] == pytest.approx(min(1, true.max() / len(g)))


def test_seventy_languages(spark):
    rng = np.random.default_rng(17)
    letters = [list(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9, replace=False)) for _ in range(70)]
    text = lambda k: " ".join("".join(rng.choice(letters[k], 6)) for _ in range(60))
    rows = [(i, text(i % 70), f"l{i % 70:02d}") for i in range(2100)]
    f = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lang, _ = langid.predict(f, [text(k).encode() for k in range(70)])
    assert len(f.languages) == 70 and f.rows.shape[1] == 2
    assert sum(x == f"l{k:02d}" for k, x in enumerate(lang)) >= 68 and lang[69] == "l69"


def test_toxicity_held_out(spark):
    from pyspark.sql import functions as F

    base = SF.replace("0.001", "0.1")
    df, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.fit(df, labels)
    out = toxicity.scored(df, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in out)
    assert hit / sum(r["predicted"] for r in out) > 0.9 and hit / sum(r["toxic"] for r in out) > 0.8
    for shown, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("idiooooot", "idiot"), ("cl0wn", "clown")):
        assert model.restore(f"the {shown} of ndon") == f"the {meant} of ndon"
        assert model.score([f"the {shown} of ndon in that here"])[0] >= toxicity.THRESHOLD
    assert model.score(["the is and of ndon in that here", ""]).max() < toxicity.THRESHOLD
    empty = toxicity.fit(df, labels.limit(0))
    assert np.allclose(empty.score(["a", ""]), 0.1, atol=0.01)


def test_disguises_of_any_form(spark):
    base = SF.replace("0.001", "0.1")
    df, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.fit(df, labels)
    forms = {"idiot": ["1d107", "idi07", "1d10t" + "!" * 20, "i  d  i  o  t", "i\nd\ni\no\nt", "idiot!"], "stupid": ["s/t/u/p/i/d", "s,t,u,p,i,d", "s t u p ! d", "s|t|u|p|i|d", "s_t_u_p_i_d", "s . t . u . p . 1 . d"], "moron": ["m" + "0" * 30 + "ron"], "ass": ["a$$"]}
    for meant, shown in forms.items():
        for x in shown:
            assert model.restore(f"the {x} of ndon") == f"the {meant} of ndon", x
    for plain in ("in 2024 of", "for $50 of", "a | b", "well !!"):
        assert model.restore(plain) == plain
    long = " ".join("stupid" * 12)
    assert "stupidstupid" in model.restore(f"the {long} of").replace(" ", "")


    for x in ("s\u200bt\u200bu\u200bp\u200bi\u200bd", "stu\u00adpid", "ｓｔｕｐｉｄ", "ＳＴＵＰＩＤ", "𝓼𝓽𝓾𝓹𝓲𝓭", "st.up.id", "st-up..id", "stupid" + "d" * 40, "5tup1d" + "d" * 40, "ｓ ｔ ｕ ｐ １ ｄ"):
        assert model.restore(f"the {x} of ndon") == "the stupid of ndon", x
        assert model.score([f"the {x} of ndon in that here"])[0] >= toxicity.THRESHOLD, x
    assert model.score(["the a s t u p i d of ndon in that here"])[0] >= toxicity.THRESHOLD
    for plain in ("state-of-the-art, and/or e.g. this.", "naïve résumé – „quoted“", "a.b.c.d e-mail"):
        assert model.score([plain])[0] < toxicity.THRESHOLD


def test_places_of_disguises_are_all_that_match(duck):
    texts = [t for (t,) in duck.sql("select text from documents order by doc_id").fetchall()]
    rng = np.random.default_rng(18)
    texts += ["".join(rng.choice(list("aab1!|$+.,-_ \n é3٣ßⅧ"), int(rng.integers(0, 60)))) for _ in range(3000)] + ["", "ooo", "!", "a.b.c"]
    texts = [toxicity.plain_letters(t) for t in texts]
    for text, places in zip(texts, toxicity.starts(texts), strict=True):
        whole = [(m.start(), m[0]) for m in toxicity.SUSPECT.finditer(text)]
        got, done = [], 0
        for at in places:
            if at >= done and (m := toxicity.SUSPECT.match(text, at)):
                got.append((at, m[0]))
                done = m.end()
        # What is left out would be left as it is.
        assert set(got) <= set(whole) and all(toxicity._PLAIN.fullmatch(x) for _, x in set(whole) - set(got)), text


def test_viterbi_is_the_best_of_all_ways():
    rng = np.random.default_rng(15)
    trigrams = np.log(rng.random((128, 128, 128)) + 1e-3).astype(np.float32)

    def cost(ways):
        total, x, y = 0.0, 0, 0
        for add, price in [*ways, (b" ", 0.0)]:
            total += price
            for byte in add:
                z = int(toxicity.SYMBOL[byte])
                total += float(trigrams[x, y, z]) if y or z else 0.0
                x, y = y, z
        return total

    for shown in ("1d10t", "s t u p ! d", "iiid|||ot", "m0r00n!", "a$$", "5t.up.1d", "é e 3 é"):
        parts = toxicity.lattice(shown, " " in shown)
        best = max(itertools.product(*parts), key=cost)
        got = toxicity.viterbi(parts, trigrams)
        ways = [w for w in itertools.product(*parts) if b"".join(a for a, _ in w) + b" " == got]
        assert ways and max(map(cost, ways)) == pytest.approx(cost(best), abs=1e-6), shown


def test_toxicity_takes_one_text_of_an_id(spark):
    df = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert abs(toxicity.fit(df, labels, 2).bias) < 1e-6  # one of each


def test_toxicity_fit_reads_all_documents(spark):
    rows = [(i, "plain words here") for i in range(40)] + [(1000 + i, "qzqzqz xkxkxk") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(40), *range(5000, 9000)]], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)  # texts without a label count
    assert model.trigrams[17, 26, 17] > model.trigrams[17, 26, 5] + 3
    kept = toxicity.labelled(df, labels, 20).count()  # ids that are not among the documents take no place
    assert kept == 20
