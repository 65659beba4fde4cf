"""The llm operators against brute force on small fixtures and on the smallest tables: nulls, empty and
long texts, repeated rows, empty tables, clashing column names."""

import base64
import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from terravane.llm import anchors, bpe, chat, crf, dac, fingerprint, linedup, media, mixing, warc
from terravane.llm.common import Workspace, connected_components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, rank string, seq string"
LONG = " ".join(f"wort{i % 977}" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a b c d e f"), (4, "a b c d e f"), (5, LONG), (6, LONG), (7, "<|endoftext|> x'll  y\n\n z "), (None, "no id here"), (8, "é中\U0001f642 \x85 1234")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, "r", "q") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.mark.parametrize("name,mod", [("op4_warc_chunks", warc), ("op7_chat_relational", chat), ("op9_line_suffix_dedup", linedup)])
def test_sql(spark, name, mod):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(getattr(mod, f"{name.split('_')[0].upper()}_SQL"))
    cols = want.columns
    got = [tuple(r[c] for c in cols) for r in getattr(mod, name)(spark, DATA).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)


def test_bpe_matches_library(library):
    own = bpe.Encoder(bpe.Vocabulary(bpe.tokenizer_path()), most_words=50, window=9)
    digests = bpe.Digester(own, most=40)
    rng = random.Random(5)
    parts = ["a", "th", " the", "  ", "\n", "é", "12", "'s", "!!", "<|endoftext|>", "漢", "🙂", "\x85", " tion", "ing", ".", ", "]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        want = library.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == want
        back = library.decode(want, skip_special_tokens=False)
        assert bpe.Decoder(own.v, block=7).decode(want) == back
        digest = len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
        assert digests.one(s) == digest
        assert [tuple(x) for x in zip(*digests.batch(pa.array([s, None, s]), longest=rng.choice([5, 1000])))][::2] == [digest, digest]


def test_bpe_streams_long_pretokens(library):
    own = bpe.Encoder(bpe.Vocabulary(bpe.tokenizer_path()))
    rng = random.Random(6)
    for s in ("a" * 90_000, "".join(rng.choice("etaoin") for _ in range(90_000)), "-=" * 40_000):
        assert own.encode(s) == library.encode(s, add_special_tokens=False).ids


def test_bpe_digests_odd_rows(spark, odd, empty, library):
    got = sorted(map(tuple, bpe.encode_digests(odd).collect()), key=str)
    want = []
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_digests(empty).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd)).collect()
    assert sorted((r[0], r[1]) for r in back if r[0]) == sorted((i, t or "") for i, t in ODD if i)


def test_dac_codes_give_random_access():
    rng = np.random.default_rng(3)
    ids = rng.choice([1, 255, 256, 50_000, 70_000, 1 << 20], 5000).astype(np.uint32)
    shard = dac.Shard(dac.pack(np.array([5, 9, 12]), np.array([0, 4000, 1000]), ids))
    assert [shard[i] for i in range(0, 5000, 3)] == ids[::3].tolist()
    assert shard.document(0).tolist() == [] and shard.document(2).tolist() == ids[4000:].tolist()
    with pytest.raises(IndexError):
        shard[5000]


def test_dac_odd_rows(spark, odd, empty, library):
    docs = odd.unionByName(odd.selectExpr("-9223372036854775808 as doc_id", "text", "lang", "source", "n_chars", "th", "rank", "seq").limit(1))
    rows = [*ODD, (-(1 << 63), None)]
    got = dac.read_shards(dac.write_shards(docs, Workspace(spark, "t"), docs_a_shard=3, ids_a_shard=40)).collect()
    start = 0
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: r["start"]), sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert dac.read_shards(dac.write_shards(empty, Workspace(spark, "t"))).count() == 0


def _simhash(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_library_encoder_by_pieces(library):
    own = dac.LibraryEncoder(bpe.tokenizer_path(), most=300)
    rng = random.Random(4)
    parts = ["a", "th", " the", "  ", "\n", "\n\n", "é", "12", "'s", "!!", "<|endoftext|>", "漢", "\x85", ".", ", ", "\t", "\r\n", "\u3000", "\x03", "\x04", "ʰ", "_x", "word***", " w\n", "1a"]
    for _ in range(6):
        texts = [None, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400))]
        counts, ids = own.encode(pa.array(texts))
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("most", [20_000, 2])
def test_anchor_links_are_all_links(spark, most):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        c = rng.getrandbits(64)
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = anchors.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most).toDF("u", "v")
    labels = {r[0]: r[1] for r in connected_components(Workspace(spark, "t"), edges).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = list(fps)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(labels.get(sign(x), sign(x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_anchor_dedup_odd_rows(spark, odd, empty):
    got = {(r[0], r[1], r[2]) for r in anchors.near_duplicates(spark, odd, width=4).collect()}
    fp = {i: _simhash(t, 4) for i, t in ODD}
    assert {(i, f % (1 << 64)) for i, f, _ in got} == set(fp.items())
    comp = {i: c for i, _, c in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[5] == comp[6] == 5
    assert anchors.near_duplicates(spark, empty).count() == 0
    assert {r["doc_id"] for r in anchors.keep_one(spark, odd).collect()} == {1, 4, 5, 7, 8, None}


def test_keep_one_tells_texts_of_one_doc_id_apart(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text of some words"), (None, "a b c d e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as own", "2 as row", "3 as id", "4 as gone_id")
    got = anchors.keep_one(spark, docs)
    assert got.columns == docs.columns
    assert sorted(map(str, (r[:2] for r in got.collect()))) == sorted(map(str, (rows[0], rows[2], rows[3], rows[4])))


@pytest.mark.parametrize("most", [4_000, 3])
def test_near_dedup_finds_similarity_of_four_fifths(spark, most):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 300))]
        for _ in range(6):
            own = list(words)
            for at in rng.sample(range(len(own)), rng.randint(0, 1 + len(own) // 35)):
                own[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in anchors.similar(spark, docs, most=most).collect()}
    assert got == dict(enumerate(root))
    assert {r["doc_id"] for r in anchors.keep_one(spark, docs).collect()} == set(root)
    assert len(set(root)) < len({anchors.simhash64(t, 5, 42) for t in texts})


def test_near_dedup_rows_a_text(spark, monkeypatch):
    made, replicas = [], anchors.replicas
    monkeypatch.setattr(anchors, "replicas", lambda *a, **b: (made.append(replicas(*a, **b)), made[-1])[1])
    texts = [" ".join(f"w{i * 50 + j}" for j in range(50)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert anchors.similar(spark, docs).where("component_id = doc_id").count() == 40
    assert max(df.count() for df in made) <= 45 * 40
    assert len(anchors.layout(15_000_000, 0.8)) <= 125


def test_blocks_meet_with_the_calculated_chance(spark):
    rng = np.random.default_rng(3)
    n, blocks = 2000, anchors.layout(1 << 20, 0.8, 0.9)
    words = blocks[-1][0] + 1
    flips = np.packbits(rng.random((n, 64 * words)) < anchors.chance(0.8), axis=1).view(np.int64)
    one = rng.integers(-(2**63), 2**63 - 1, (n, words))
    fps = spark.createDataFrame([(i * 2 + k, w) for k, x in enumerate((one, one ^ flips)) for i, w in enumerate(x.tolist())], "node long, words array<long>")
    met = anchors.replicas(fps, blocks, homes=True).selectExpr("anchor", "node div 2 as pair").groupBy("anchor", "pair").count().where("count = 2").select("pair").distinct().count()
    assert 0.88 <= met / n <= 0.93


def test_sieve_lets_all_its_rows_pass(spark):
    own = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 1 << 40, -(1 << 40)] + list(range(5, 10**12, 10**10))
    rest = [x + 7 for x in own if x < 1 << 62]
    keys = spark.createDataFrame([(x,) for x in own], "row long")
    for some, least, most in ((keys, len(own), len(own) + 3), (keys.limit(0), 0, 0)):
        got = anchors._sifted(spark.createDataFrame([(x, "t") for x in own + rest], "row long, text string"), anchors._sieve(some)).where("passes").collect()
        assert least <= len(got) <= most and (not least or set(own) <= {r["row"] for r in got})
        assert got == [] or got[0].asDict().keys() == {"row", "text", "passes"}


def test_keep_one_deals_out_no_text_that_stays(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 37 * 50 + j}" for j in range(50))) for i in range(40)] + [(None, "a b"), (None, None), (50, None), (51, "")], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = anchors.keep_one(spark, docs)
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [*((False, i) for i in range(37)), (False, 50), (True, 0), (True, 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in plan and plan.count("strategy=broadcast") == 2


def test_fingerprints_odd_rows(spark, odd, empty):
    rows = [(i, t) for i, t in ODD if i and i != 4]
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(spark, odd.where("doc_id <> 4"), docs_a_bucket=2).collect()}
    ids = sorted((i for i, _ in rows), reverse=True)
    text = dict(rows)
    for k, i in enumerate(ids):
        t, n = text[i] or "", text[ids[(k + 1) % len(ids)]] or ""
        m = len(t) // 3
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest()
    assert got[5]["fp"] == got[6]["fp"] and got[1]["fp"] == got[2]["fp"] == 0
    assert fingerprint.edited_fingerprints(spark, odd).count() == len(ODD)
    assert fingerprint.edited_fingerprints(spark, empty).count() == 0


def test_fingerprint_bits_are_majorities(spark):
    texts = ["a b c d e f g", "A b\tc", "x", " ", None, "é ü é ü é ü é", LONG]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    hashes = [r[0] for r in spark.sql("select xxhash64(cast('a' as string), 'b', 'c', 'd', 'e')").collect()]
    assert len(hashes) == 1
    got = {r["k"]: r["fp"] for r in fingerprint.fingerprint_rows(docs, ["k"]).collect()}
    for k, t in enumerate(texts):
        words = (t or "").lower().split()
        if not words:
            assert got[k] == 0
            continue
        shingles = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
        rows = spark.createDataFrame([tuple([*s, *[None] * (5 - len(s))]) for s in shingles], "a string, b string, c string, d string, e string")
        h = [r[0] % (1 << 64) for r in rows.selectExpr("xxhash64(a, b, c, d, e)").collect()]
        assert got[k] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_block_tables_find_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(30)]
    every = sorted({x ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for x in base for _ in range(10)})
    q = every[::7]
    got = fingerprint.near_fingerprints(spark.createDataFrame([(x,) for x in q], "q long"), spark.createDataFrame([(x,) for x in every], "fp long")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in q for b in every if 1 <= (a ^ b).bit_count() <= 3)


def test_line_dedup_odd_rows(spark, odd, empty):
    run = "\n".join(f"zeile {k} hat so etwa acht worte in sich" for k in range(8))
    rows = [(1, "kopf\n" + run + "\nfuss"), (2, run), (3, "x\n\n" + run.replace("\n", "\n\n")), (4, "kurz\nkurz\nkurz"), (5, None), (6, ""), (7, run.split("\n")[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as th", "2 as seq", "3 as n", "77 as n_lines", "5 as __gone", "6 as own", "7 as gone", "8 as lines")
    got = {r["doc_id"]: r for r in linedup.delete_repeats(spark, docs).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_deleted"] == 0
    assert got[2]["text"] == "" and got[2]["n_deleted"] == 8
    assert got[3]["text"].strip() == "x" and got[4]["n_deleted"] == 0 and got[5]["text"] is None and got[6]["n_lines_"] == 0 and got[7]["n_deleted"] == 0
    assert all(r["n_lines"] == 77 and r["th"] == 1 and r["__gone"] == 5 for r in got.values())
    assert linedup.delete_repeats(spark, odd).count() == len(ODD) and linedup.delete_repeats(spark, empty).count() == 0


def test_maximal_runs(spark):
    line = lambda k: f"line {k} has some eight words in it all"
    long, short = [line(k) for k in range(14)], [line(k) for k in range(50, 57)]
    rows = [(1, [*long, "a"]), (2, ["b", *long, "c", *short]), (3, [*short, "d", *long[3:12], "", "e", *long]), (4, ["f", *long[:4]])]
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    got = sorted((r["doc_id"], r["seq"], r["lines"], r["first"]["doc_id"], r["first"]["seq"]) for r in linedup.repeated_runs(spark, docs).collect())
    assert got == [(2, 1, 14, 1, 0), (3, 0, 7, 2, 16), (3, 8, 9, 1, 3), (3, 18, 14, 1, 0)]


def test_media_round_trip_and_carving(spark, odd, empty, tmp_path):
    got = {r["doc_id"]: r for r in media.features(Workspace(spark, "t").table(media.store(odd), "m")).collect()}
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        wav = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        assert (got[i]["tail_crc32"], got[i]["media_bytes"], got[i]["media_sha256"]) == (zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest())
        assert f"samples={len(payload)};silent={payload.count(0)};level={sum(payload) / len(payload):.6f};" in got[i]["feature"]
    assert media.features(media.store(empty)).count() == 0
    import gzip

    inner = gzip.compress(b"hello" * 50)
    data = b"BM junk " + inner + b"tail"
    kind, carved = media.Sniffer().sniff(data)
    assert kind == media.UNKNOWN and [m[:3] for m in carved] == [(8, len(inner), "application/gzip")]
    rows = spark.createDataFrame([(1, "image/png", bytearray(media.wav8(b"abc"))), (2, "audio/wav", None), (3, None, bytearray(b""))], "id long, declared string, media binary")
    assert {r["id"]: (r["type"], r["corrected"]) for r in media.correct_types(rows).collect()} == {1: ("audio/wav", True), 2: (None, True), 3: (media.UNKNOWN, True)}


def test_media_end_marks():
    import io
    import zipfile

    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a", "b" * 50)
    pdf = b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"
    data = b"PK\x03\x04 no" + box.getvalue() + b"--" + pdf + b"%PDF- open"
    _, carved = media.Sniffer().sniff(data)
    assert [(m[0], m[1], m[2]) for m in carved] == [(7, len(box.getvalue()), "application/zip"), (9 + len(box.getvalue()), len(pdf), "application/pdf")]
    many = b"%PDF- PK\x03\x04 " * 100_000
    assert media.Sniffer().media(many) == []


def test_warc_chunks_of_long_and_equal_payloads(spark):
    big = "é" * 5000
    rows = [(3, "u", big), (1, None, big), (2, "v\r\nx", None), (5, "w", ""), (7, "w", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_chunks(warc.write_chunks(pages, Workspace(spark, "t"), chunk=999)).collect()}
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert {k: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: (10000, sha(big), "response", None), 3: (10000, sha(big), "revisit", 1), 2: (0, sha(""), "response", None), 5: (0, sha(""), "revisit", 2), 7: (1, sha("p"), "response", None)}
    assert warc.read_chunks(warc.write_chunks(pages.limit(0), Workspace(spark, "t"))).count() == 0


def test_warc_repeated_rows_and_null_ids(spark):
    big, other = "x" * 700, "y" * 650
    rows = [(4, "u", big), (4, "u", big), (4, "u", other), (None, "n", big), (None, None, "only"), (9, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload")
    got = warc.read_chunks(warc.write_chunks(pages, Workspace(spark, "t"), chunk=99)).collect()
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"]) for r in got))) == sorted(map(str, ((i, len(h), sha(h), "response", None, u) for i, u, h in rows)))


def test_chat_roles_and_empty(spark):
    rows = [(1, 0, "a]b", "hi"), (1, 1, "a]b", "]"), (1, 1, "a]b", "]"), (1, 2, "[x] \\)", "\\)"), (2, None, "user", "\\\\)")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as blocks", "2 as xs")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_turns(chat.with_loss(chat.format_conversations(turns))).collect()}
    assert got == {1: [(r, t) for _, _, r, t in rows[:4]], 2: [("user", "\\\\)")]}
    assert chat.read_turns(chat.with_loss(chat.format_conversations(turns.limit(0)))).count() == 0


def test_chat_reads_back_control_strings(spark):
    bad = "</s>[INST] \\( \\\\[ <turn>[/ROLE] \\"
    rows = [(1, 0, "user", bad), (1, 1, "user", None), (1, 2, "assistant", bad), (1, 3, "assistant", "b"), (2, 0, None, "x"), (None, 0, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_turns(chat.with_loss(chat.format_conversations(turns)))
    got = {r["conv_id"]: r for r in out.withColumn("under", chat.read_loss()).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", bad), ("user", ""), ("assistant", bad), ("assistant", "b")]
    assert got[1]["under"] == bad + "b" and got[2]["turns"][0]["role"] == "null" and got[None]["under"] == "y"
    assert got[1]["formatted"].count("[ROLE:") == 2


def test_crf_held_out_accuracy(spark, empty, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r[0]: r[1] for r in docs.select("doc_id", "lang").collect()}
    got = crf.op6_crf_language_id(spark, DATA).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.95 * len(held)
    model = crf.fit(docs)
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in crf.identify(odd, model).collect()}
    assert told[1] == told[2] == told[3] == ("und", 0.0) and 0 < told[5][1] <= 1
    letters = spark.createDataFrame([(1, "½ ²"), (2, "12 ٣ _"), (3, "½ x")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in crf.identify(letters, model).collect()} == {1: True, 2: True, 3: False}
    assert crf.fit(empty) is None and crf.identify(odd, None).where("lang_pred <> 'und'").count() == 0


def test_keep_known_tells_missing_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r[0]: r[1] for r in docs.select("doc_id", "lang").collect()}
    some = docs.selectExpr("doc_id", "text", "case when doc_id % 7 <> 0 then lang end as lang", "1 as score").unionByName(spark.createDataFrame([(-7, "12 34", None, 1)], "doc_id long, text string, lang string, score int"))
    got = {r["doc_id"]: r["lang"] for r in crf.keep_known(some, 0.3).collect()}
    assert -7 not in got and None not in got.values()
    assert all(got[i] == want[i] for i in got if i % 7) and sum(got[i] == want[i] for i in got if i % 7 == 0) >= 0.9 * sum(i % 7 == 0 for i in got)


def test_crf_gradient_is_numeric():
    """Gold minus expected counts, which training climbs by, against differences of the log-likelihood."""
    rng = np.random.default_rng(1)
    e, m, s = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths, gold = np.array([4, 2]), np.array([0, 2, 1, 1, 2, 0])

    def likelihood(e, m, s):
        told = e[np.arange(6), gold].sum() + s[gold[0]] + s[gold[4]] + sum(m[gold[i], gold[i + 1]] for i in (0, 1, 2, 4))
        return told - crf.forward_backward(e, lengths, m, s, pairs=True)[3]

    post, pairs, begun, _ = crf.forward_backward(e, lengths, m, s, pairs=True)
    seen, first = np.zeros((3, 3)), np.bincount(gold[[0, 4]], minlength=3)
    for i in (0, 1, 2, 4):
        seen[gold[i], gold[i + 1]] += 1
    own = (np.eye(3)[gold] - post, seen - pairs, first - begun)
    for k, (x, g) in enumerate(zip((e, m, s), own)):
        for at in np.ndindex(x.shape):
            args = [a.copy() for a in (e, m, s)]
            args[k][at] += 1e-5
            up = likelihood(*args)
            args[k][at] -= 2e-5
            assert abs((up - likelihood(*args)) / 2e-5 - g[at]) < 1e-5


def test_crf_draws_runs_from_whole_texts():
    text = " ".join(f"w{i}" for i in range(5000))
    runs = crf.draw_runs(text, 240)
    assert len(runs) == 20 and all(len(r) == crf.RUN for r in runs)
    assert sum(int(r[0][1:]) >= 2500 for r in runs) >= 4
    assert crf.draw_runs("a b", 240) == [["a", "b"]] and crf.draw_runs("", 240) == []


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    e, m, s = rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    post = crf.forward_backward(e, np.array([3, 2]), m, s)
    want = np.zeros((5, 2))
    for lo, hi in ((0, 3), (3, 5)):
        z = 0
        for code in range(2 ** (hi - lo)):
            path = [code >> k & 1 for k in range(hi - lo)]
            p = np.exp(s[path[0]] + sum(e[lo + k, y] for k, y in enumerate(path)) + sum(m[a, b] for a, b in zip(path, path[1:])))
            z += p
            for k, y in enumerate(path):
                want[lo + k, y] += p
        want[lo:hi] /= z
    assert np.allclose(post, want)


def test_mixing_meets_targets(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix(spark, docs, labels, {"clean": 0.8, "low": 0.12, "toxic": 0.08}).collect()
    sums = np.sum([np.array(r["p"]) * r["tokens"] * r["rate"] for r in rows], axis=0)
    assert np.allclose(sums / sums.sum(), [0.8, 0.12, 0.08], atol=0.03)
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 + 1e-6 for r in rows)
    assert mixing.mix(spark, odd, labels.limit(0)).count() == len(ODD)
    assert mixing.mix(spark, empty, labels).count() == 0


def _scored(spark, shares, n=3000):
    """(doc_id, tokens, p) whose likeliest domains have these shares."""
    rng = np.random.default_rng(4)
    kind = rng.choice(3, n, p=shares)
    z = rng.normal(0, 1, (n, 3))
    z[np.arange(n), kind] += 5
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    rows = [(i, int(t), x) for i, (t, x) in enumerate(zip(rng.integers(50, 800, n), p.tolist()))]
    return spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>").coalesce(4).cache()


@pytest.mark.parametrize("shares", [(0.78, 0.11, 0.11), (0.97, 0.02, 0.01), (0.98, 0.01, 0.01)])
def test_clean_documents_stay_at_every_mix(spark, shares):
    scored = _scored(spark, shares)
    rows = mixing.rates(scored, mixing.fit_rates(scored, corpus_pipeline.TARGETS, 1.0, bounds=True), 1.0, bounds=True).collect()
    assert all(r["rate"] == 1 for r in rows if max(r["p"]) == r["p"][0])
    assert np.mean([r["rate"] for r in rows if max(r["p"]) == r["p"][2]]) < 0.9


def test_rates_of_rare_domains_converge(spark):
    scored = _scored(spark, (0.98, 0.01, 0.01))
    rows = mixing.rates(scored, mixing.fit_rates(scored, corpus_pipeline.TARGETS, 1.0), 1.0).collect()
    assert np.mean([r["rate"] for r in rows if max(r["p"]) == r["p"][2]]) < 0.02
    rows = mixing.rates(scored, mixing.fit_rates(scored, mixing.TARGETS, 4.0), 4.0).collect()
    sums = np.sum([np.array(r["p"]) * r["tokens"] * r["rate"] for r in rows], axis=0)
    assert np.allclose(sums / sums.sum() / [0.95, 0.04, 0.01], 1, atol=0.02)
    with pytest.warns(RuntimeWarning, match="haven't converged"):
        mixing.fit_rates(scored, mixing.TARGETS, 4.0, steps=2)


def test_rates_are_least_squares(spark):
    """Against a plain projected gradient over all rows at once, with targets that no rates meet."""
    scored = _scored(spark, (0.8, 0.15, 0.05), n=400)
    rows = scored.orderBy("doc_id").collect()
    tokens, p = np.array([r["tokens"] for r in rows], float), np.array([r["p"] for r in rows])
    goal_share, most = np.array([0.2, 0.2, 0.6]), 1.5
    now = tokens @ p
    goal = goal_share * min(now.sum(), *(now * most / goal_share))
    weight = 1 / np.maximum(np.diag((tokens[:, None] * p).T @ p), 1e-9)

    def miss(r):
        return float(weight @ ((tokens * r) @ p - goal) ** 2)

    r = np.ones(len(rows))
    for _ in range(20_000):
        gap = weight * ((tokens * r) @ p - goal)
        r = np.clip(r - 0.3 * p @ gap, 0, most)
    got = mixing.rates(scored, mixing.fit_rates(scored, dict(zip(mixing.DOMAINS, goal_share)), most), most).orderBy("doc_id").collect()
    assert miss(np.array([x["rate"] for x in got])) <= miss(r) + 1e-3 * miss(np.ones(len(rows)))


def test_no_labels_thin_nothing(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    assert mixing.keep_mixed(spark, docs, labels.limit(0), corpus_pipeline.TARGETS).count() == docs.count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "bpe_encode"]
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() <= docs.count()
