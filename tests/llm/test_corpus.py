"""Near-duplicates, decontamination, sharding, chats, archives, the pipeline; and odd tables for all."""

import base64
import gzip
import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kestrelqc.operators import graph
from kestrelqc.llm import bpe, chat, decontamination, joins, langid, nearcopies, quality, sharding, simhash, toxicity, warc


def brute_components(n, near):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if near(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = {r["v"]: r["root"] for r in graph.components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    together = {frozenset(p) for p in links}
    expect = brute_components(341, lambda i, j: frozenset((i, j)) in together)
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (expect[a] == expect[b])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot_rows", [4096, 5])
def test_near_duplicates(spark, duck, monkeypatch, hot_rows):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot_rows)
    rows = duck.sql("select doc_id, text from documents order by doc_id").fetchall()
    rows += [(9000 + i, t) for i, t in enumerate([None, "", " \n", "one", "One", "É four words here", "é four words here"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = [fingerprint(t) for _, t in rows]
    root = brute_components(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    for k, (i, _) in enumerate(rows):
        assert got[i]["fingerprint"] == f"{fp[k]:016x}" and got[i]["component_id"] == rows[root[k]][0]


@pytest.mark.parametrize("hot_rows", [4096, 7])
def test_ring_finds_every_near_pair(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot_rows)
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fp = list(dict.fromkeys(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(12)))
    df = spark.createDataFrame([(i, f.to_bytes(8, "big")) for i, f in enumerate(fp)], "doc_id long, fp binary")
    root = brute_components(len(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.linked(df, simhash.EXACT).collect()}
    assert [got[i] for i in range(len(fp))] == root


def test_keep_one_of_near_copies(spark, duck):
    texts = [t for (t,) in duck.sql("select text from documents where n_chars between 1500 and 4000 order by doc_id limit 12").fetchall()]
    rows, rng = [], np.random.default_rng(7)
    for i, t in enumerate(texts):
        w = t.split(" ")
        near = list(w)
        near[int(rng.integers(5, len(w) - 5))] = "replaced"
        rows += [(10 * i, t), (10 * i + 1, t), (10 * i + 2, " ".join(near)), (10 * i + 3, " ".join(w[: len(w) // 2]))]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {10 * i + k for i in range(len(texts)) for k in (0, 3)}


def test_near_copies_of_one_id(spark):
    base = [" ".join(f"{x}{k}" for k in range(60)) for x in "abcd"]
    rows = [(1, base[0], "x"), (1, base[1], "x"), (2, base[2], "x"), (2, base[3], "x")]  # unlike texts: all stay
    rows += [(3, base[0] + " more", "x"), (None, base[1] + " end", "y"), (None, base[3], "z"), (None, "alone at last", "x"), (None, "alone at last", "w"), (1, base[0], "w"), (4, "", "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string").withColumn("m", F.create_map(F.lit("a"), F.col("gone")))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, base[0]), (1, base[1]), (2, base[2]), (2, base[3]), (None, "alone at last"), (4, ""), (4, None)], key=str)


def test_chains_lose_no_near_pair():
    rng = np.random.default_rng(10)
    for ring in (nearcopies.SHORT, nearcopies.WIDE):
        a = rng.integers(0, 1 << 63, (500, ring.bits // 64), np.uint64)
        turned = np.stack([rng.permutation(ring.bits) < n for n in rng.integers(ring.most // 2, 2 * ring.most, 500)])
        b = a ^ np.packbits(turned, axis=1).view(np.uint64)
        assert (ring.near(a, b) == (turned.sum(axis=1) <= ring.most)).all()


@pytest.mark.parametrize("group_rows", [1024, 6])
def test_near_copies_by_exact_similarity(spark, monkeypatch, group_rows):
    monkeypatch.setattr(nearcopies, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(nearcopies, "RUN_ROWS", group_rows)
    rng, rows = np.random.default_rng(11), []
    for base in range(40):
        words = [f"w{base}x{k}" for k in range(104)]
        rows.append(words)
        for _ in range(3):  # runs at the end are changed, so similarities lie on both sides of 0.8
            cut = int(rng.integers(4, 20))
            rows.append([*words[:-cut], *(f"v{len(rows)}x{k}" for k in range(cut))])
    rows += [[f"c{k}" for k in range(4 * j, 4 * j + 100)] for j in range(20)]  # a chain of near copies
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in rows]
    root = brute_components(len(rows), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert {r["doc_id"]: r["leader"]["doc_id"] for r in nearcopies.groups(df).collect()} == dict(enumerate(root))
    assert len(set(root)) < len(rows) - 30 and len(set(root)) > 50


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_against_alignment(spark, duck):
    items = [(i, t) for i, t in duck.sql("select item_id, text from benchmark order by item_id limit 6").fetchall()]
    docs = duck.sql("select doc_id, text from documents where n_chars < 600 order by doc_id limit 12").fetchall()
    rng, rows = np.random.default_rng(8), []
    for k, (i, t) in enumerate(docs):
        item = items[k % len(items)][1]
        edited = list(item)
        for _ in range([0, 3, 8, 40][k % 4]):
            edited[int(rng.integers(len(edited)))] = "q"
        rows.append((i, t[:150] + " " + "".join(edited) + " " + t[150:]))
    rows += [(7000, items[0][1]), (7001, None), (7002, ""), (None, items[1][1])]
    index = decontamination.Index.of(items)
    expect = set()
    for i, t in rows:
        n = decontamination.normalised(t or "")
        for p in range(len(index.held)):
            if edit_distance(bytes(index.text[p, : index.size[p]]), n) <= index.budget[p]:
                expect |= {(i, item) for item in index.held[p]}
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "short")], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == expect
    clean = decontamination.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in expect}


def test_short_leaks_at_any_place(spark, duck):
    items = [(i, t) for i, t in duck.sql("select item_id, text from benchmark where length(text) >= 250 order by item_id limit 4").fetchall()]
    host = duck.sql("select text from documents where n_chars between 300 and 600 order by doc_id limit 1").fetchall()[0][0]
    rows, rng = [], np.random.default_rng(12)
    for _ in range(60):
        i, t = items[int(rng.integers(len(items)))]
        t = decontamination.normalised(t).decode("latin-1")
        a = int(rng.integers(len(t) - 80))
        rows.append((len(rows), host[:150] + " " + t[a : a + 80].strip() + " " + host[150:]))
    short = [(900, "Zorblatt?"), (901, "qua zib 17")]
    rows += [(100, f"{host} so (zorblatt) is"), (101, host + " zorblatts"), (102, "Qua, zib 17"), (103, "qua zib 171"), (104, host)]
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, *short], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {*range(60), 100, 102}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] >= 900} == {(100, 900), (102, 901)}


def test_leaks_of_a_shared_opening(monkeypatch):
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9))))
    opening = " ".join(word() for _ in range(20))
    items = [(i, opening + " " + " ".join(word() for _ in range(20))) for i in range(2000)]
    index, began = decontamination.Index.of(items), time.time()
    tail = decontamination.normalised(items[77][1])[-90:].decode()
    text = decontamination.normalised((opening + " and ") * 5000 + "so " + tail + " " + opening)
    found = decontamination.search(index, [text, b"", decontamination.normalised(items[5][1])])
    assert len(text) > 500_000 and time.time() - began < 30
    by = lambda t: {i for f in found if f[0] == t for i in index.held[f[1]]}
    assert by(0) == by(2) == set(range(2000))  # all hold the opening
    most = Counter(i for f in found if f[0] == 0 for i in index.held[f[1]]).most_common(2)
    assert most[0][0] == 77 and most[0][1] > most[1][1]  # and only one its own part
    monkeypatch.setattr(decontamination, "ENTRIES", 5000)
    assert decontamination.search(index, [text[-2000:]]) and decontamination.search(index, [text, b"", decontamination.normalised(items[5][1])]) == found


@pytest.mark.parametrize("unit", [0, 60])
def test_repeating_texts_lose_nothing(monkeypatch, unit):
    monkeypatch.setattr(decontamination, "HEAVY", -1)
    rng, items = np.random.default_rng(14), [(0, "the quick brown fox jumps over the lazy dog while seven wizards brew potent ale in the cold dark cellar of the old inn")]
    index = decontamination.Index.of(items)
    for _ in range(20):
        t = list(items[0][1])
        for _ in range(int(rng.integers(0, 14))):
            t[int(rng.integers(len(t)))] = "q"
        text = decontamination.normalised(("".join(t) + " " + "pad " * int(rng.integers(0, unit + 1))) * (7 if unit else int(rng.integers(1, 4))))
        expect = {p for p in range(len(index.held)) if edit_distance(bytes(index.text[p, : index.size[p]]), text) <= index.budget[p]}
        assert {f[1] for f in decontamination.search(index, [text])} == expect


def test_leaks_in_blocks(spark, monkeypatch):
    df, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, decontamination.leaks(df, bench).collect()))
    monkeypatch.setattr(decontamination, "blocks", lambda b, chars=3000, f=decontamination.blocks: f(b, chars))
    assert sorted(map(tuple, decontamination.leaks(df, bench).collect())) == one and one


def test_qgrams():
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    for n in (0, 7, 8, 9, 15, 16, 26):
        got = decontamination.qgrams(data[:n])
        assert got.tolist() == [int.from_bytes(bytes(data[k : k + 8]), "little") for k in range(max(0, n - 7))]


def test_sharding(spark, duck):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for limit in (1 << 30, 60_000, 9_000):
        got = sharding.sharded(df, limit).withColumnRenamed("key", "doc_id").toPandas()
        expect = duck.sql(sharding.sql(limit)).df()
        key = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values.tolist()))
        assert key(got) == key(expect)
    sizes = got.groupby("shard").agg({"n_bytes": "sum", "doc_id": "count"})
    assert ((sizes["n_bytes"] <= limit) | (sizes["doc_id"] == 1)).all() and len(sizes) > 20
    names = sorted(sizes.index)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))


def test_sharding_of_one_key(spark, tmp_path):
    rows = [(1, "x" * 100)] * 60 + [(2, None), (None, "y" * 5), (3, "z" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.sharded(df, 500).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["n_bytes"].agg(["sum", "count"])
    assert ((sizes["sum"] <= 500) | (sizes["count"] == 1)).all()
    assert sharding.sharded(df.limit(0)).count() == 0
    sharding.write_shards(spark.read.parquet(f"{SF}/documents.parquet"), f"{tmp_path}/shards", 60_000)
    back = spark.read.option("basePath", f"{tmp_path}/shards").parquet(f"{tmp_path}/shards")
    assert back.count() == 200 and back.select("shard").distinct().count() > 3


def test_written_shards_of_a_hot_key(spark, tmp_path):
    rows = [("web", f"{i:04d}" + "x" * 96) for i in range(900)] + [(None, "y" * 50)] * 30 + [(f"s{i}", "z" * 80) for i in range(50)]
    df = spark.createDataFrame(rows, "source string, text string").repartition(3)
    shards = sharding.write_shards(df, f"{tmp_path}/shards", 1000, "source").collect()
    back = spark.read.option("basePath", f"{tmp_path}/shards").parquet(f"{tmp_path}/shards").select("source", "text", "shard").collect()
    assert sorted((r["source"] or "", r["text"]) for r in back) == sorted((a or "", b) for a, b in rows)
    sizes = {}
    for r in back:
        sizes.setdefault(r["shard"], []).append(len(r["text"]))
    assert max(sum(v) for v in sizes.values()) <= 1000
    assert sorted((sum(v), len(v)) for v in sizes.values()) == sorted((r["shard_bytes"], r["shard_rows"]) for r in shards)


def test_shards_keep_a_column_of_that_name(spark, tmp_path):
    rows = [(7, "x" * 1000, "own", i) for i in range(2000)] + [(None, None, None, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Shard string, row int").repartition(4)
    shards = sharding.write_shards(df, f"{tmp_path}/out", 2000).collect()
    back = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out").collect()
    sizes = Counter()
    for r in back:
        sizes[r["shard_"]] += len(r["text"] or "")
    assert sorted(r["row"] for r in back) == [-1, *range(2000)] and {r["Shard"] for r in back} == {"own", None}
    assert max(sizes.values()) <= 2000 and len(sizes) == len(shards)


def test_query_functions(spark, duck):
    from kestrelqc.llm import queries

    n = duck.sql("select count(*) from documents").fetchall()[0][0]
    for name, f in queries.QUERIES.items():
        out = f(spark, SF)
        columns = sorted(out.columns)
        got = sorted((tuple(r) for r in out.select(columns).collect()), key=str)
        if name in queries.SQL:
            assert got == sorted(duck.sql(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall(), key=str), name
        elif name != "op1_decontamination":
            assert len(got) == n and len({r[columns.index("doc_id")] for r in got}) == n, name
    library = tiktoken_library()
    got = {r["doc_id"]: r for r in queries.op3_byte_bpe(spark, SF).collect()}
    for i, t in duck.sql("select doc_id, text from documents").fetchall():
        ids = library.encode_ordinary(t or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i]["n_tokens"] == len(ids)


def tiktoken_library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SAID = r"\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    rows = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (1, 0, "user", None), (1, 1, "assistant", "\\\\</turn></turn"), (1, 1, "assistant", "b"), (1, 2, "a: b\\", "### x"), (2, None, None, ""), (None, 0, "assistant", "né")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    written = chat.write_formatted(chat.events_of(df))
    got = {r["conv_id"]: r for r in chat.read_back(written).collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat.rendered(r, x)[0]) for r, x in turns)
    assert chat.write_formatted(chat.events_of(df.limit(0))).count() == 0


def test_chat_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 50)
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} ###") for i in range(40)]
    parts = chat.write_formatted(chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    r = chat.read_back(parts).first()
    assert r["n_turns"] == 40 and r["loss_sha256"] == hashlib.sha256("".join(x[3] for x in rows if x[1] % 2).encode()).hexdigest()


def test_chat_events(spark):
    events = [
        (1, 10, 0, 1, "message", "user", "hi"), (1, 11, 1, 2, "delta", "assistant", "he"), (1, 11, 1, 3, "delta", None, "llo"),
        (1, 11, 1, 4, "regenerate", None, None), (1, 11, 1, 5, "delta", None, "good "), (1, 11, 1, 6, "delta", None, "day"),
        (1, 10, 0, 7, "edit", None, "hey"), (1, 12, 2, 8, "message", "user", "gone"), (1, 12, 2, 9, "delete", None, None), (2, 1, 0, 1, "delta", "user", "x"),
    ]
    df = spark.createDataFrame(events, "conv_id long, message long, turn long, seq long, kind string, role string, text string").repartition(4)
    got = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.folded(df).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "user", "hey"), (1, 1, "assistant", "good day"), (2, 0, "user", "x")]


@pytest.mark.parametrize("hot", [100_000, 3])
def test_chat_logs_fold_to_what_was_said(spark, monkeypatch, hot):
    monkeypatch.setattr(chat, "HOT_EVENTS", hot)
    said = [(k % 3, t, ("user", "assistant", None)[t % 3], ("né" * t + "x", "", None, SAID, "ab")[(k + t) % 5]) for k in range(7) for t in range(9)] + [(None, None, "assistant", "z"), (5, 1, "assistant", "twice"), (5, 1, "assistant", "twice")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat.log_of(df)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "edit", "delta", "regenerate"}
    got = [tuple(r) for r in chat.folded(log.repartition(5, F.rand(1))).collect()]
    assert Counter(got) == Counter((c, t, r or "", x or "") for c, t, r, x in said)


def sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("compress", [True, False])
def test_archives(spark, compress):
    rows = [(1, "http://a\r\nb", "same"), (5, "u", "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (9, "u", "é" * 3000), (9, "u", "é" * 3000), (None, "u", "same"), (11, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    files = warc.written_records(df, compress=compress)
    got = warc.read_records(files, range_bytes=700).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for i, _, h in rows:
        b = (h or "").encode()
        same = [x for x, _, y in rows if (y or "") == (h or "")]
        top = max((x for x in same if x is not None), default=None)
        for r in by[i]:
            assert r["payload_bytes"] == len(b) and r["payload_digest"] == sha1(b)
            assert (r["record_type"], r["refers_to"]) == (("response", None) if i == top else ("revisit", top))
            assert r["record_type"] == "revisit" or r["payload"] == b
    assert warc.read_records(warc.written_records(df.limit(0), compress=compress)).count() == 0
    more = {r["page_id"]: r["record_type"] for r in warc.read_records(warc.written_records(df, least=5, compress=compress)).collect()}
    assert set(more.values()) == {"response"}


def test_archives_with_hot_pages(spark, monkeypatch):
    monkeypatch.setattr(joins, "sized", lambda df, most=0: df)
    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    rows = [(i, "u", "hot" if i % 2 else f"twice {i // 4}") for i in range(40)] + [(None, "u", "hot"), (None, "u", None)]
    got = warc.read_records(warc.written_records(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert len(got) == len(rows) and all((by[i]["record_type"] == "response") == (i == max(k for k, _, h in rows[:40] if h == rows[i][2])) for i in by)
    assert sum(r["refers_to"] == 39 for r in got) == 20


def archive(path, name, records):
    (path / name).write_bytes(b"".join(records))
    return f"{path}/{name}"


def test_archives_of_others(spark, tmp_path):
    def rec(i, body, more=""):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    inner = gzip.compress(rec("inner", b"not a record of the file"), 0)
    bodies = [b"one", bytes(np.random.default_rng(1).integers(0, 256, 300_000, np.uint8)), b"GET " + inner + b" end", b""]
    records = [rec(i, b) for i, b in enumerate(bodies)]
    many = archive(tmp_path, "a.warc.gz", [gzip.compress(r, k) for r, k in zip(records, (6, 1, 0, 9))])
    whole = archive(tmp_path, "b.warc.gz", [gzip.compress(b"".join(records))])
    long = archive(tmp_path, "c.warc", [records[0], rec(1, bodies[1], "X-Long: " + "x" * 200_000 + "\r\n"), *records[2:]])
    empty = archive(tmp_path, "d.warc", [])
    for path in (many, whole, long):
        for step in (1 << 25, 5000):
            got = {r["record_id"]: r for r in warc.read_records(warc.listed(spark, path), range_bytes=step).collect()}
            assert {f"<urn:uuid:{i}>": b for i, b in enumerate(bodies)} == {k: bytes(r["payload"]) for k, r in got.items()}
            assert all(r["payload_digest"] == sha1(r["payload"]) and r["page_id"] is None for r in got.values())
    assert warc.read_records(spark.createDataFrame([(empty, 0)], "file string, bytes long")).count() == 0
    for name in ("a.warc.gz", "b.warc.gz", "c.warc"):
        for cut in (0, 7):  # cut at the end, or no archive at all
            data = (tmp_path / name).read_bytes()
            broken = archive(tmp_path, "broken." + name, [data[:-9]] if cut == 0 else [b"x" * cut + data])
            with pytest.raises(PySparkException, match="chain of records breaks"):
                warc.read_records(warc.listed(spark, broken)).collect()


def test_reachable():
    rng = np.random.default_rng(9)
    for _ in range(30):
        at = np.unique(np.append(rng.integers(1, 400, 60), 0))
        nxt = np.array([int(rng.choice(np.append(at[at > a], 1000))) for a in at])
        expect, here = set(), 0
        step = dict(zip(at.tolist(), nxt.tolist(), strict=True))
        while here in step:
            expect.add(here)
            here = step[here]
        assert set(at[warc.reachable(at, nxt)].tolist()) == expect


def test_pipeline_stages(spark, duck):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {i for (i,) in duck.sql("select doc_id from documents").fetchall()}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name != p.STAGES[-1][0]:
            assert out.columns == columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= ids
        ids = {r["doc_id"] for r in rows}
        if name != p.STAGES[-1][0]:
            docs = spark.createDataFrame(rows, docs.schema)
    assert 100 < len(ids) < 200
    leaked = {r["doc_id"] for r in decontamination.leaks(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaked and not leaked & ids
    assert {r["doc_id"] for r in p.run(spark, SF).select("doc_id").collect()} == ids


def test_odd_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows, other columns by clashing names, no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, fp string, component_id int, h int, shard string"
    long = "word and more of it " * 20_000
    rows = [(i, t, None, None, None, None, None, "f", 1, 2, "s") for i, t in ((1, None), (2, ""), (3, "a b"), (3, "a b"), (3, "other words"), (None, "null id"), (4, long), (5, long), (None, None), (6, "日本 語"))]
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1), (3, 1, 1), (3, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "x" * 90), (2, "")], "item_id long, text string")
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = df.count()
        ratio, model = quality.fit(df, labels), toxicity.fit(df, labels)
        assert quality.judge(df, ratio).count() == n == toxicity.scored(df, model).count()
        assert quality.keep(df, ratio).columns == df.columns == toxicity.keep(df, model).columns
        assert quality.keep(df, ratio).count() == 0 and toxicity.keep(df, model).count() <= n
        assert bpe.encode_decode(df, bpe_path()).count() == n
        assert langid.identified(df, langid.fit(df)).count() == n
        assert simhash.near_duplicates(df).count() == n
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] or 0) for r in kept.collect()) == ([0, 0, 1, 2, 3, 3, 4, 6] if n else [])
        assert decontamination.leaks(df, bench).count() == 0 and decontamination.clean(df, bench).count() == n
        assert sharding.sharded(df, 1000).count() == n


def bpe_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
